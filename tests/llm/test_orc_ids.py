import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from shelfrank.llm import orc_ids as O
from shelfrank.llm import words as W
from shelfrank.llm.storage import settings

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Hello, World! it's 3.14 <|endoftext|> x", None, "", "  \n\t ", "naïve café. ÉCOLE, l'été!! 漢字 🙂🙂 áb ≠ x.", "don't. 'quoted' rock'n'roll's.",
    "a" * 5000, "<|ENDOFTEXT|> <|startoftext|>.", "one.two,three;four |x| 50% #tag $5 &amp; *a*", "Σίσυφος ΣΑΣ.", "x y z\x1cw", "word " * 3000, "».« ² ①.",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 % 13, t, i, "f") for i, t in enumerate(TEXTS)] + [(4, "again", 0, "f"), (4, "again", 0, "f"), (None, "no id", 0, "f")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids int, file string").repartition(3)


def test_files_against_the_tokenizer(spark, docs):
    tokenizer = Tokenizer.from_file(PATH)
    want, start = [], 0
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()))
    for there, doc, text in rows:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        want.append((doc if there else None, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in O.index(spark, O.write_ids(docs, PATH)).orderBy("start").collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[2:])
    assert sorted((r[0] is not None, r[0] or 0, *r[2:]) for r in got) == sorted((r[0] is not None, r[0] or 0, *r[2:]) for r in want)
    assert [key(r)[:2] for r in got] == [key(r)[:2] for r in want]
    assert [r[1] for r in got] == list(np.cumsum([0, *[r[2] for r in got[:-1]]]))


def test_ranges_and_metadata(spark, docs):
    import glob

    from pyarrow import orc

    folder = O.write_ids(docs, PATH)
    assert sorted(r.doc_id for r in O.read_ids(spark, folder, 3, 6).collect()) == sorted(r.doc_id for r in docs.collect() if r.doc_id is not None and 3 <= r.doc_id <= 6)
    files = [orc.ORCFile(f) for f in glob.glob(folder.removeprefix("file://") + "/*.orc")]
    assert files and all(f.row_index_stride == 10_000 for f in files)
    plan = O.read_ids(spark, folder, 3, 6)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,3)" in plan


def test_empty_table(spark, docs):
    assert O.index(spark, O.write_ids(docs.limit(0), PATH)).count() == 0


def _encode(chunks, texts):
    return chunks.encode(*W.column_bytes(pa.array([(t or "").encode() for t in texts], pa.large_binary())))


def test_forgetting_changes_nothing():
    chunks = O.Chunks(Tokenizer.from_file(PATH))
    whole, counts = _encode(chunks, TEXTS)
    parts = [_encode(O.Chunks(chunks.tokenizer), [t]) for t in TEXTS]
    assert np.concatenate([p for p, _ in parts]).tolist() == whole.tolist()
    assert [int(c[0]) for _, c in parts] == counts.tolist()


@pytest.mark.parametrize("before, after", [("", "."), ("a", "!"), ("al", "*x"), ("", ".,;:!?|%&$#*")])
def test_every_letter_before_punctuation(before, after):
    """Some letters end in a combining mark once composed and lower-cased, and take the punctuation with them."""
    tokenizer = Tokenizer.from_file(PATH)
    texts = [before + c + after for c in map(chr, range(0x110000)) if c.isalpha()]
    ids, counts = _encode(O.Chunks(tokenizer), texts)
    want = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_one_id_of_many_rows_in_several_files(spark):
    rows = [(7, f"text {i}") for i in range(400)] + [(8, "last"), (None, "first")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    with settings(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):
        folder = O.write_ids(docs, PATH)
    assert spark.read.orc(folder).where("doc_id = 7").select("_metadata.file_path").distinct().count() > 1
    got = O.index(spark, folder).orderBy("start").collect()
    assert [r.start for r in got] == list(np.cumsum([0, *[r.n_tokens for r in got[:-1]]]))
    assert got[0].doc_id is None and got[-1].doc_id == 8


def test_parts_seen_before_are_not_sorted_again(monkeypatch):
    chunks = O.Chunks(Tokenizer.from_file(PATH))
    data, offsets = W.column_bytes(pa.array([(t or "").encode() for t in TEXTS], pa.large_binary()))
    first = chunks.encode(data, offsets)
    assert len(chunks) == (chunks.early_number >= 0).sum()  # no two of these words share a place
    monkeypatch.setattr(np, "unique", None)
    again = chunks.encode(data, offsets)
    assert all(np.array_equal(a, b) for a, b in zip(first, again, strict=True))


def test_parts_that_share_a_place(monkeypatch):
    monkeypatch.setattr(O, "EARLY_BITS", 1)
    monkeypatch.setattr(O, "_EARLY_SHIFT", np.uint64(63))
    tokenizer = Tokenizer.from_file(PATH)
    chunks = O.Chunks(tokenizer)
    for texts in (TEXTS, TEXTS[::-1]):
        texts = [t or "" for t in texts]
        ids, counts = chunks.encode(*W.column_bytes(pa.array([t.encode() for t in texts], pa.large_binary())))
        assert [list(x) for x in np.split(ids, np.cumsum(counts)[:-1])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("piece", [W.PIECE_BYTES, 2])
def test_word_hashes_against_plain_sums(monkeypatch, piece):
    monkeypatch.setattr(W, "PIECE_BYTES", piece)
    monkeypatch.setattr(W, "_TABLES", {})
    texts = [b"", b"Some words, \xc3\xa9t\xc3\xa9 words", b"next", b" some ", b""]
    found = W.split(*W.column_bytes(pa.array(texts, pa.large_binary())))
    want = [(i, w) for i, t in enumerate(texts) for w in t.lower().split()]
    base = int(W._BASE)
    sums = np.array([(sum((c + 1) * base ** (k + 1) for k, c in enumerate(w)) + len(w)) % 2**64 for _, w in want], np.uint64)
    assert list(found.text) == [i for i, _ in want] and list(found.hash) == list(W.mix(sums))
    assert set(W._TABLES) == (set() if piece == 2 else {W._BASE, W._INVERSE})


def test_workers_remember_parts_between_tasks(spark, docs):
    """Spark sends a task copies of the variables its function names: what a task learnt was lost with them."""

    def seen(batches):
        from shelfrank.llm import orc_ids

        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, orc_ids._SEEN.values()))])], names=["n"])

    O.encode(docs, PATH).collect()
    assert max(r.n for r in docs.select("doc_id").mapInArrow(seen, "n long").collect()) > 0


def test_many_pieces_against_the_tokenizer(monkeypatch):
    monkeypatch.setattr(O, "RECENT", 8)
    tokenizer = Tokenizer.from_file(PATH)
    random = np.random.default_rng(1)
    words = ["".join(map(chr, random.integers(0x61, 0x7B, random.integers(1, 12)))) for _ in range(2000)] + ["école", "été", "x1", "don't", "ends."]
    chunks = O.Chunks(tokenizer)
    assert chunks.bare
    for _ in range(30):
        texts = [" ".join(random.choice(words, 40)) for _ in range(5)]
        ids, counts = _encode(chunks, texts)
        want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == [i for w in want for i in w]
        assert counts.tolist() == [len(w) for w in want]
    assert len(chunks.known) + len(chunks.recent) == len(chunks) == len(np.unique(chunks.first[: len(chunks)]))


def test_model_alone_only_where_the_other_steps_keep_words():
    from tokenizers import normalizers, pre_tokenizers

    for change in (
        lambda t: setattr(t, "normalizer", normalizers.Replace("e", "x")),
        lambda t: setattr(t, "pre_tokenizer", pre_tokenizers.Split("q", "isolated")),
        lambda t: t.add_tokens(["word"]),
    ):
        tokenizer = Tokenizer.from_file(PATH)
        change(tokenizer)
        assert O._bare(tokenizer) is None
