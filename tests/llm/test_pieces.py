import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from sentencepiece import SentencePieceProcessor

from shelfrank.llm import pieces as P
from shelfrank.llm import words as W

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "Hello  world\n x", None, "", " ", "   ", "\n\n", "héé ñ 漢字仮名 🙂 x", "a" * 300, " " * 100 + "z", "ab" * 200, "<s> </s> <0x0A> <unk>",
    "the the the.", "Internationalization of " * 4000, "ﬁ​́x", "1234567890 " * 30, "tab\tsep\rret", "\x00\x01",
]


def test_ids_against_the_library(spark):
    model = SentencePieceProcessor(model_file=PATH)
    draw = random.Random(1)
    texts = TEXTS + ["".join(draw.choice("abcdet  hrnio.\né漢") for _ in range(draw.randrange(200))) for _ in range(150)]
    rows = spark.createDataFrame([(i, t, "x", [1]) for i, t in enumerate(texts)] + [(0, texts[0], "x", [1])], "doc_id long, text string, n_pieces string, ids array<int>")
    encoded = P.encode(rows, PATH)
    assert encoded.columns == ["doc_id", "n_pieces", "ids"]
    got = encoded.collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert list(r.ids) == model.encode(texts[r.doc_id] or ""), texts[r.doc_id]
    back = {r.doc_id: r.text for r in P.decoded(encoded, PATH).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    for r in P.digest(rows, PATH).collect():
        ids = model.encode(texts[r.doc_id] or "")
        assert (r.n_pieces, r.ids_crc32, r.round_trip) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)


def test_what_does_not_come_back(spark):
    row = P.digest(spark.createDataFrame([(1, "a▁b")], "doc_id long, text string"), PATH).first()
    assert not row.round_trip
    assert P.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_suffix_array_and_occurrences():
    pieces = P.Pieces(PATH)
    text = "▁the▁theme"
    points = np.array([ord(c) for c in text] + [-1])
    order = P.suffix_array(points, pieces.longest)
    pad = list(points) + [-2] * 20
    assert [pad[i : i + 16] for i in order] == sorted(pad[i : i + 16] for i in range(len(points)))
    low, high = P.occurrences(points, order, pieces)
    found = {(int(order[k]), "".join(map(chr, pieces.points[p][: pieces.length[p]]))) for p in range(len(low)) for k in range(low[p], high[p])}
    names = {"".join(map(chr, pieces.points[p][: pieces.length[p]])) for p in range(len(low))}
    assert found == {(i, n) for n in names for i in range(len(text)) if text.startswith(n, i)}


def test_batches_and_memory_change_nothing(monkeypatch):
    pieces = P.Pieces(PATH)
    texts = [(t or "").encode() for t in TEXTS]
    whole = P.Encoder(pieces).encode(texts)[0].tolist()
    monkeypatch.setattr(P, "REMEMBERED", 0)
    encoder = P.Encoder(pieces)
    assert [i for t in texts for i in encoder.encode([t])[0].tolist()] == whole
    monkeypatch.setattr(P, "LONG", 3)  # all by the queue
    assert P.Encoder(pieces).encode(texts)[0].tolist() == whole


def test_memory_for_a_batch_of_texts():
    import tracemalloc

    text = pa.array([b"some words of a long text " * 4000] * 40, pa.large_binary())
    tracemalloc.start()
    for _, _, found in W.pieces(text):
        assert len(found.hash)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20  # 23 MB at half a MB of text at a time, 90 at two MB
