import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from shelfrank.llm import alignment as A

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  ", "Hello, World! it's 3.14 <|endoftext|> x", "  \n\t ", "naïve café. ÉCOLE, l'été!! 漢字 🙂🙂 áb ≠ x.", "a ▁b", "a  b   c  d", "trailing  \n ", "</s><s> <unk> <0x41>",
    "Straßenüberführung und Äpfel\r\n\tund Öl", "abcabcabc" * 200, "x " * 500, "１２３ ² ①\x00\x1c y", "👨‍👩‍👧 ক্ষ ไทย ​ z", "don't  stop   me　 now ", "def f(x):\n    return  x  # ok\n", "Pneumonoultramicroscopic Donaudampfschiff " * 3, "repeat me " * 40,
]


def plain(text, tokenizer, model):
    """Token ids of both kinds and the groups, straight from the definition."""
    if not text:
        return [], [], []
    value = A.ByteLevel(PATHS[0]).bytes if not hasattr(plain, "a") else plain.a
    plain.a = value
    a = tokenizer.encode(" " + text, add_special_tokens=False).ids
    b = model.encode(text)
    a_bytes = [value[i] for i in a]
    b_bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [model.id_to_piece(i)]]
    want = (" " + text).encode()
    if b"".join(a_bytes) != want or b"".join(b_bytes) != want:
        return [], [], []
    ends = [list(np.cumsum([len(t) for t in x])) for x in (a_bytes, b_bytes)]
    groups, i, j = [], 0, 0
    for stop in sorted(set(ends[0]) & set(ends[1])):
        m, n = ends[0].index(stop) + 1, ends[1].index(stop) + 1
        groups.append((a[i:m], b[j:n]))
        i, j = m, n
    return a, b, groups


def plain_table(rows):
    tokenizer, model = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    tokenizer.encode_special_tokens = True
    found = [(d, *plain(t, tokenizer, model)) for d, t in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for _, _, _, g in found]
    count = Counter(p for own in links for p in own)
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for (d, a, b, g), own in zip(found, links):
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)
        n_best = sum(n for p, n in own.items() if count[p] == most[p[0]])
        out.append((d, len(a), len(b), len(g), sum(own.values()), n_best, sum(n * count[p] for p, n in own.items()), text))
    return out


def odd_texts(seed, n):
    rng = random.Random(seed)
    parts = [" ", "  ", "\n", "\t", "a", "the", "Ing", "é", "é", "漢", "🙂", " ", " ", "​", "'s", "'", ".", "...", "1", "2024", "▁", "İ", "ß", "<s>", "_", "\x00", "\x1f", "ﬁ", "א", "इि"]
    return ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(n)]


@pytest.mark.parametrize("frequent", [1 << 20, 0, 40])
def test_against_the_definition(spark, monkeypatch, frequent):
    """Whether all pairs, none or some are sent to the tasks changes nothing."""
    monkeypatch.setattr(A, "FREQUENT", frequent)
    rows = list(enumerate(TEXTS + odd_texts(frequent, 60))) + [(4, "again"), (4, "again"), (None, "no id the id")]
    docs = spark.createDataFrame([(d, t, 1, "p") for d, t in rows], "doc_id long, text string, n_a int, pairs string").repartition(4)
    got = A.rate(A.align(docs, *PATHS))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    key = lambda r: (r[0] is not None, *(0 if v is None else v for v in r))
    want = plain_table(rows)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    assert sum(r[3] > 0 for r in want) > 50


def test_digest_and_reading(spark):
    docs = spark.createDataFrame([(1, "Hello there, friend"), (2, "")], "doc_id long, text string")
    whole, short = (A.align(docs, *PATHS, digest=d).orderBy("doc_id").collect() for d in (False, True))
    assert [r.groups for r in short] == [hashlib.sha256(whole[0].groups.encode()).hexdigest(), ""]
    groups = A.split_groups(whole[0].groups)
    assert len(groups) == whole[0].n_groups and sum(len(a) for a, _ in groups) == whole[0].n_a and A.split_groups("") == []


def test_cuts_are_safe():
    """Cut by cut and cut free of each other: the ids are those of the whole text."""
    cuts = A.Cuts(A.ByteLevel(PATHS[0]), A.SentencePieces(PATHS[1]))
    assert not cuts.b.whole
    texts = odd_texts(7, 3000)
    column = A._with_space(A.pa.array([t.encode() for t in texts], A.pa.large_binary()))
    sums, groups, *_ = cuts.align(*column)
    for text, own, s in zip(texts, groups, sums):
        a, b, g = plain(text, cuts.a.tokenizer, cuts.b.model)
        assert (own.decode(), s[0], s[1]) == (";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g), len(a), len(b)), text


def test_groups_by_pointers():
    rng = random.Random(3)
    for _ in range(200):
        total = rng.randrange(1, 60)
        ends = [np.array(sorted({*rng.sample(range(1, total + 1), rng.randrange(total)), total})) for _ in range(2)]
        a, b = A.groups_of(*ends)
        common = sorted(set(ends[0]) & set(ends[1]))
        assert a.tolist() == np.searchsorted(common, ends[0]).tolist() and b.tolist() == np.searchsorted(common, ends[1]).tolist()


def test_one_long_group():
    """Tokens that never end together but at the last byte are one group, however many they are."""
    a, b = A.groups_of(np.append(np.arange(2, 200_000, 2), 200_001), np.append(np.arange(1, 200_000, 2), 200_001))
    assert not a.any() and not b.any()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert A.rate(A.align(docs, *PATHS)).count() == 0
