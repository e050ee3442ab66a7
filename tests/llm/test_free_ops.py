"""The numpy-backed operators and the pipeline against plain versions."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loanlens.llm import bpe, line_dedup, lm, ngram_join, quality_classifier, sharding
from loanlens.llm.components import connected_components
from helpers import INSIDE, CLASHES, ODD, empty, frame


class Sets:
    """Union-find."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def near_copies(n=60, seed=4):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(3, 120))]
        texts.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 4])):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(" ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    return texts


# --- components ------------------------------------------------------------------------------------------------------

def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5)]
    want = Sets()
    for a, b in edges:
        if a != b:
            want.join(a, b)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: want.find(x) for x in want.up}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- n-gram join -----------------------------------------------------------------------------------------------------

def plain_components(texts, ids, k, percent):
    def grams(t):
        w = tuple((t or "").encode("utf-8").lower().split())
        return frozenset([w] if 0 < len(w) < k else [w[i:i + k] for i in range(len(w) - k + 1)])
    sets = [grams(t) for t in texts]
    links = Sets()
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j]:
                both = len(a & sets[j])
                if 100 * both >= percent * (len(a) + len(sets[j]) - both):
                    links.join(i, j)
    least = {}
    for i in range(len(texts)):
        if ids[i] is not None:
            r = links.find(i)
            least[r] = min(least.get(r, ids[i]), ids[i])
    return [(ids[i], len(sets[i]), least.get(links.find(i)) if sets[i] else ids[i]) for i in range(len(texts))]


@pytest.mark.parametrize("tiny", [False, True])
def test_ngram_join(spark, monkeypatch, tiny):
    if tiny:      # many column blocks and flushes, tiles for groups of few rows
        for name, value in (("TASK_TOKENS", 150), ("BLOCK_TOKENS", 400), ("FLUSH_TOKENS", 300)):
            monkeypatch.setattr(ngram_join, name, value)
    texts = near_copies() + ODD
    ids = [None if i == 7 else 1000 - i for i in range(len(texts))]
    for k, percent in ((4, 85), (5, 80)):
        got = ngram_join.similar_components(frame(spark, texts, ids=ids).repartition(5), k, percent).collect()
        key = lambda x: (str(x[0]), x[1], str(x[2]))
        assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=key) == sorted(plain_components(texts, ids, k, percent), key=key)
    assert ngram_join.similar_components(empty(spark)).count() == 0


def test_one_of_each(spark):
    texts = near_copies(25, seed=9) + [None, "", "", "same words here", "same words here"]
    ids = list(range(len(texts)))
    ids[-1] = ids[-2]                                   # a repeated row
    docs = frame(spark, texts, ids=ids)
    got = ngram_join.one_of_each(docs)
    assert got.columns == docs.columns
    parts = plain_components(texts, ids, 5, 80)
    want = sorted({(i, texts[n]) for n, (i, size, low) in enumerate(parts) if size and i == low} | {(ids[n], texts[n]) for n in range(len(texts)) if not parts[n][1]},
                  key=str)
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=str) == want


def test_hub_group_costs_no_pairs():
    rng = np.random.default_rng(0)
    base = np.sort(rng.choice(1 << 40, 200, replace=False)).astype(np.uint64)
    sets = [np.sort(np.concatenate([np.delete(base, i % 200), [np.uint64((1 << 41) + i)]])) for i in range(800)]
    links = ngram_join.link_forest(sets, 85)
    joined = Sets()
    for a, b in links:
        joined.join(a, b)
    assert len({joined.find(i) for i in range(800)}) == 1 and len(links) < 1600


def test_link_forest_of_many_components():
    # windows of 40 of a row of n-grams link up to a shift of 3; the first three rows hit nothing, so that batches follow
    rng = random.Random(0)
    for _ in range(1500):
        n = rng.randint(5, 30)
        at = [10_000, 20_000, 30_000] + [rng.randrange(3 * n) for _ in range(n)]
        sets = [np.arange(x, x + 40, dtype=np.uint64) for x in at]
        want, got = Sets(), Sets()
        for i, x in enumerate(at):
            for j in range(i):
                if abs(x - at[j]) <= 3:                 # 100 * 37 >= 85 * 43
                    want.join(i, j)
        for a, b in ngram_join.link_forest(sets, 85):
            assert abs(at[a] - at[b]) <= 3
            got.join(a, b)
        assert [got.find(i) for i in range(len(at))] == [want.find(i) for i in range(len(at))]


# --- line dedup ------------------------------------------------------------------------------------------------------

def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abé", max_size=80), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 80), st.sampled_from("abé")), max_size=4), st.sampled_from([0, 1, 2, 3, 4, 9, 40]))
def test_banded_edit_distance(a, edits, limit):
    b = list(a)
    for kind, at, c in edits:
        at = min(at, len(b))
        b[at:at + (kind > 0)] = [c] if kind < 2 else []
    b = "".join(b)
    assert line_dedup.within(a, b, limit) == (edit_distance(a, b) <= limit)


def test_edit_distance_of_many_pairs_at_once():
    """As one by one, at word bounds of the band and for lines of other lengths (before: one by one only, 0.5 ms a pair)."""
    rng = random.Random(19)
    for size in (5, 40, 63, 64, 65, 128, 300):
        base = "".join(rng.choice("abcdé ") for _ in range(size))
        texts = sorted((damaged(rng, base, rng.randint(0, min(size - 2, 25)), "abcd") for _ in range(20)), key=len, reverse=True)
        pairs = [(i, j, e) for i in range(20) for j in range(i + 1, 20) for e in [rng.randint(0, min(line_dedup.BAND, len(texts[i])))]
                 if len(texts[i]) - len(texts[j]) <= e]
        sizes = np.array([len(t) for t in texts])
        _, codes = np.unique([ord(c) for t in texts for c in t], return_inverse=True)
        got = line_dedup.batch_within(codes, np.cumsum(sizes) - sizes, sizes, int(codes.max()) + 1, *np.array(pairs).T)
        assert got.tolist() == [line_dedup.within(texts[i], texts[j], e) for i, j, e in pairs]


def segment_stays(a, b, bands):
    """Whether a segment of one line is in the other near its place, counted from its own end."""
    for x, y in ((a, b), (b, a)):
        own, to = (int(bands.band(np.array(len(s)))) for s in (x, y))
        if own not in (to, int(bands.band(np.array(len(y) - int(bands.limit(np.array(len(y)))))))):
            continue
        n, parts = int(bands.size[own]), int(bands.parts[own])
        for i in range(parts):
            j = i // 2
            p, q = (x, y) if i % 2 == 0 else (x[::-1], y[::-1])
            if any(at >= 0 and p[j * n:(j + 1) * n] == q[at:at + n] for at in range(j * n - j, j * n + j + 1)):
                return True
    return False


def plain_line_dedup(docs, least, edits, percent=0):
    bands = line_dedup.Bands(edits, percent, least)
    lines = {}
    for i, t in sorted(docs):
        for j, x in enumerate((t or "").split("\n")):
            if len(x) >= least:
                lines.setdefault(x, []).append((i, j))
    links = Sets()
    names = list(lines)
    chars = {x: collections.Counter(x) for x in names}
    for n, a in enumerate(names):
        for b in names[:n]:
            reach = max(edits, percent * min(len(a), len(b)) // 100)
            if abs(len(a) - len(b)) <= reach and (chars[a] - chars[b]).total() <= reach and (chars[b] - chars[a]).total() <= reach:
                if edit_distance(a, b) <= reach if reach < 4 else line_dedup.within(a, b, reach):
                    # beyond ``SURE`` edits a pair is found only if a segment is left
                    if line_dedup.within(a, b, max(edits, line_dedup.SURE)) or segment_stays(a, b, bands):
                        links.join(a, b)
    first = {}
    for x in names:
        r = links.find(x)
        first[r] = min(first.get(r, (1 << 60, 0)), lines[x][0])
    return {i: None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if len(x) < least or first[links.find(x)] == (i, j)) for i, t in docs}


def damaged(rng, text, edits, alphabet):
    x = list(text)
    for _ in range(edits):
        at, kind = rng.randrange(len(x)), rng.randrange(3)
        x[at:at + (kind > 0)] = [rng.choice(alphabet)] if kind < 2 else []
    return "".join(x)


def test_segments_find_every_pair_up_to_their_number():
    """Edits spread at random, at any length and across the bounds of bands: up to ``SURE`` no pair is lost."""
    rng = random.Random(12)
    bands = line_dedup.Bands(line_dedup.EDITS, line_dedup.PERCENT, line_dedup.MIN_CHARS)
    assert (bands.limit(bands.low[1:] - 1) < np.diff(bands.low)).all()
    for _ in range(3000):
        a = "".join(rng.choice("abcd ") for _ in range(int(40 * 1.012 ** rng.randrange(300))))
        reach = min(line_dedup.SURE, max(line_dedup.EDITS, len(a) * line_dedup.PERCENT // 100))
        b = damaged(rng, a, reach, "abcdé")
        if a != b and len(b) >= 40 and line_dedup.within(a, b, min(reach, max(2, len(b) * 5 // 100))):
            assert line_dedup.edit_links([a, b], bands), (a, b)
        for links in (line_dedup.edit_links([a, a[:20] + "".join(rng.choice("xyz") for _ in a[20:])], bands),):
            assert not links


def test_replaced_words_in_long_lines():
    """Beyond ``SURE`` edits: of copies with up to three replaced words, of 5 per cent of the line at most, few are lost."""
    rng = random.Random(13)
    bands = line_dedup.Bands(line_dedup.EDITS, line_dedup.PERCENT, line_dedup.MIN_CHARS)
    near = found = 0
    for _ in range(1500):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(30, 200))]
        copy = list(words)
        for _ in range(rng.randint(1, 3)):
            copy[rng.randrange(len(copy))] = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
        a, b = " ".join(words), " ".join(copy)
        if a != b and line_dedup.within(a, b, min(len(a), len(b)) * 5 // 100):
            near += 1
            found += len(line_dedup.edit_links([a, b], bands))
    assert near > 1000 and found >= 0.95 * near


def spread(rng, text, edits):
    """The worst case: edits at equal distances, so that no segment is much longer than the others."""
    x = list(text)
    for i in range(edits, 0, -1):
        at, kind = i * len(text) // (edits + 1), rng.randrange(3)
        x[at:at + (kind > 0)] = ["#"] if kind < 2 else []
    return "".join(x)


def test_spread_edits_are_found_at_any_length(spark):
    """No pair within the threshold is lost, be it beyond five edits: by the segments in one task and by the keys' blocks."""
    rng = random.Random(14)
    bands = line_dedup.Bands(line_dedup.EDITS, line_dedup.PERCENT, line_dedup.MIN_CHARS)
    pairs = []
    for size in (60, 120, 139, 152, 250, 400, 620, 698, 699, 810, 1200, 5000, 20_000):
        for _ in range(3):
            a = "".join(rng.choice("abcdefgh ") for _ in range(size))
            b = spread(rng, a, max(2, len(a) * 5 // 100 * 19 // 20))
            if line_dedup.within(a, b, max(2, min(len(a), len(b)) * 5 // 100)):
                pairs.append((a, b))
                assert line_dedup.edit_links([a, b], bands), size
    assert len(pairs) > 30
    texts = [t for p in pairs for t in p]
    rng.shuffle(texts)
    got = line_dedup.remove_repeated_lines(frame(spark, texts)).collect()
    assert sum(r._gone for r in got) == len(pairs)


@pytest.mark.parametrize("tile, percent", [(6000, 0), (3, 0), (6000, 10), (3, 10)])
def test_line_dedup(spark, monkeypatch, tile, percent):
    monkeypatch.setattr(line_dedup, "TILE", tile)
    monkeypatch.setattr(line_dedup, "FLUSH_KEYS", 200)
    rng = random.Random(5)
    pool = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(12, 40))) for _ in range(12)]
    texts = []
    for _ in range(30):
        out = []
        for _ in range(rng.randint(1, 5)):
            x = list(rng.choice(pool))
            for _ in range(rng.randint(0, 3)):
                x[rng.randrange(len(x))] = rng.choice("abcdé")
            out.append("".join(x) if rng.random() < 0.8 else "short")
        texts.append("\n".join(out))
    texts += [None, "", "\n\n", "z" * 3000, "y" + "z" * 2999]
    docs = frame(spark, texts)
    got = line_dedup.remove_repeated_lines(docs, percent=percent, least=12)
    assert [c for c in got.columns if c not in ("_lines", "_gone", "_left")] == docs.columns
    want = plain_line_dedup(list(enumerate(texts)), 12, 2, percent)
    for r in got.collect():
        assert r.text == want[r.doc_id], r.doc_id
        assert r.n_chars == (None if r.text is None else len(r.text))
    assert line_dedup.remove_repeated_lines(empty(spark)).count() == 0


def test_keys_of_long_lines_grow_with_their_characters(spark):
    """What is sent to let lines meet is in proportion to the text, however many edits a line is allowed (before: about 20 bytes a character)."""
    rng = random.Random(15)
    bands = line_dedup.Bands(line_dedup.EDITS, line_dedup.PERCENT, line_dedup.MIN_CHARS)
    for size in (60, 300, 900, 3000):
        texts = ["".join(rng.choice("abcdefgh ") for _ in range(size)) for _ in range(30_000 // size)]
        sent = line_dedup._packed_keys(frame(spark, texts), bands, 4, 0, len(bands.low)).collect()
        assert 0 < sum(len(v) for r in sent for v in r if isinstance(v, (bytes, bytearray))) < 12 * size * len(texts)


def test_keys_take_few_bytes_in_any_number_of_blocks(spark):
    """A line's hash and sums aren't sent with each of its keys (before: 24 bytes a key, some 8 a character)."""
    rng = random.Random(17)
    bands = line_dedup.Bands(line_dedup.EDITS, line_dedup.PERCENT, line_dedup.MIN_CHARS)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(200)]
    for n_blocks in (4, 40):
        sent = line_dedup._packed_keys(frame(spark, texts), bands, n_blocks, 0, len(bands.low)).collect()
        assert 0 < sum(len(v) for r in sent for v in r if isinstance(v, (bytes, bytearray))) < 5 * 300 * 200


def test_pairs_of_many_near_copies_grow_with_their_number():
    """Entries that meet nothing are left out without a loss of pairs, and a group of near copies makes about a pair a line (before: up to a pair of each two)."""
    rng = random.Random(18)
    bands = line_dedup.Bands(line_dedup.EDITS, line_dedup.PERCENT, line_dedup.MIN_CHARS)
    base = "".join(rng.choice("abcdefgh ") for _ in range(300))
    texts = [damaged(rng, base, 5, "abcd") for _ in range(150)] + ["".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(50)]
    lines = line_dedup.Lines()
    lines.load(texts, 40)
    every = np.arange(len(lines.size))
    key, at, place, index = (np.concatenate(c) for c in zip(*lines.anchors(bands, every, 0, len(bands.low)), strict=True))
    key = (key.astype(np.uint32) & np.uint32(0xFFFFFFFC)) | index
    ends = np.stack([place, lines.size[at] - place], 1).astype(np.uint16)
    may = line_dedup.may_meet(bands, key, at, ends)
    assert 0 < may.sum() < len(may)
    groups = []
    for some in (may, may | True):
        pair, stands = line_dedup.met_at(bands, key[some], at[some], ends[some], lines.sums(every)[at[some]])
        links = Sets()
        for a, b in pair.tolist():
            links.join(a, b)
        groups.append([links.find(i) for i in range(len(texts))])
        assert len(pair) < 3 * len(texts)
    assert groups[0] == groups[1]


@pytest.mark.parametrize("alike", [0, 8])
def test_line_dedup_in_rounds(spark, monkeypatch, alike):
    """Rounds by length, blocks of few keys and lines that stand for others lose no pair of copies of common words."""
    monkeypatch.setattr(line_dedup, "ALIKE", alike)
    monkeypatch.setattr(line_dedup, "BLOCK_KEYS", 300)
    monkeypatch.setattr(line_dedup, "MEET_PAIRS", 50)
    rng = random.Random(16)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(25)]
    texts = []
    for size in (42, 45, 58, 66, 100, 101, 106, 150, 230, 420):
        base = " ".join(rng.choice(words) for _ in range(size))[:size]
        for _ in range(6):
            texts.append(damaged(rng, base, rng.randint(0, max(2, size // 20) + 2), "abcd "))
    rng.shuffle(texts)
    bands = line_dedup.Bands(2, 5, 40)
    assert len(bands.rounds([(len(t), len(t)) for t in texts], line_dedup.ROUNDS)) > 2
    want = plain_line_dedup(list(enumerate(texts)), 40, 2, 5)
    got = line_dedup.remove_repeated_lines(frame(spark, texts)).collect()
    assert {r.doc_id: r.text for r in got} == want
    assert 20 < sum(r._gone for r in got) < 55


def test_line_dedup_of_short_lines(spark):
    verse = "\n".join(f"verse {i} ends" for i in range(6))
    long = "a line that is long enough " * 3
    texts = [f"{long}1\n{verse}\nno", "own line", f"begin\n\n{verse}\nno\nend", "}\n}", "}", "\n".join(["again and"] * 10), None]
    texts += [f"Released by us\n{'x' * 50}{i * 99}" for i in range(12)] + ["twice only", "twice only"]
    got = {r.doc_id: r for r in line_dedup.remove_repeated_lines(frame(spark, texts), edits=0, percent=0, many=10).collect()}
    want = list(texts)
    want[2] = "begin\n\nend"
    want[5] = "\n".join(["again and"] * 5)
    for i in range(8, 19):
        want[i] = texts[i].split("\n")[1]
    assert [got[i].text for i in range(len(texts))] == want
    assert got[2]._gone == 7 and got[2]._lines == 7
    assert [r.text for r in line_dedup.remove_repeated_lines(frame(spark, texts), edits=0, percent=0).orderBy("doc_id").collect()] == texts
    assert line_dedup.remove_repeated_lines(empty(spark), many=10).count() == 0


# --- BPE -------------------------------------------------------------------------------------------------------------

def test_bpe_like_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    path = bpe.tokenizer_path()
    library = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(2)
    texts = ODD + ["I'LL can't 123 4.5!!", "<|startoftext|>a<|endoftext|><|endoftext|>b <|other|>", "\x1c\x85​　a", "İΣ ǅ ﬁ é",
                   "Ᲊ Ƛ \U00016ea0 ՘x"] + ["".join(rng.choice("abcdehilnorst'éß ,.1\n") for _ in range(200)) for _ in range(200)]
    made = bpe.decode(bpe.encode(frame(spark, texts), path), path).select("doc_id", "n_tokens", "ids", "decoded", *CLASHES).collect()
    assert len(made) == len(texts)
    for r in made:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
        assert r["size"] == "x"
    assert bpe.encode(empty(spark), path).count() == 0


def test_bpe_whole_vocabulary():
    tokenizers = pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    path = bpe.tokenizer_path()
    encoder = bpe.TrieEncoder(bpe.read_tables(path))
    words = [w.removesuffix("</w>") * 2 for w in encoder.vocab]
    want = tokenizers.Tokenizer.from_file(path).encode_batch(words, add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_block(words)] == [x.ids for x in want]


def test_bpe_takes_a_run_apart_once(monkeypatch):
    """Runs between white space are split and encoded the first time only; full tables are emptied, with the same ids."""
    tables = bpe.read_tables(bpe.tokenizer_path())
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["it's", "12,5", "naïve\x1cso", "Σας", "a<|endoftext|>b", "the", "end."]) for _ in range(50)) for _ in range(40)]
    encoder, calls = bpe.TrieEncoder(tables), []
    split = encoder.pieces
    monkeypatch.setattr(encoder, "pieces", lambda run: calls.append(run) or split(run))
    ids = encoder.encode_block(texts)
    assert encoder.encode_block(texts) == ids
    assert len(calls) == len(set(calls)) == 8
    monkeypatch.setattr(bpe, "WORDS", 3)
    small = bpe.TrieEncoder(tables)
    assert [x for t in texts for x in small.encode_block([t])] == ids


# --- language model --------------------------------------------------------------------------------------------------

def test_lm_base_score_and_gain(spark):
    rng = random.Random(8)
    texts = list(ODD)
    for i in range(400):      # two vocabularies: the word before tells which
        v = "ab" if i % 2 else "xy"
        texts.append(" ".join(v[0] + str(int(rng.paretovariate(0.7)) % 50) + v[1] for _ in range(rng.randint(5, 60))))
    got = lm.learn_and_score(frame(spark, texts)).collect()
    tokens = lambda t: (t or "").encode().lower().split() + [b"\n"]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    c = collections.Counter(x for i, t in enumerate(texts) if not held[i] for x in tokens(t))
    n, v = sum(c.values()), len(c)
    assert len(got) == len(texts)
    for r in got:
        w = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
    new = [r for r in got if r.held_out and r.doc_id >= len(ODD)]
    assert sum(r.score for r in new) > sum(r.base_score for r in new)
    assert lm.learn_and_score(empty(spark)).count() == 0


def test_lm_is_normalised():
    rng = np.random.default_rng(3)
    pairs = rng.poisson(2.0, (40, 40)).astype(np.float32)
    pairs[:20, :20] *= 8
    model = lm.train_nce(pairs, dims=8)
    p = np.exp(model.log_probs(np.arange(40)))
    assert np.allclose(p.sum(1), 1, atol=1e-4)
    # better than the unigram distribution on its own pairs
    uni = pairs.sum(0) / pairs.sum()
    assert (pairs * np.log(p)).sum() > (pairs * np.log(uni)).sum()


# --- classifier ------------------------------------------------------------------------------------------------------

def test_classifier(spark):
    rng = random.Random(6)
    texts, labels = [], []
    for i in range(900):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randint(20, 80))]
        kind = i % 3
        if kind == 0:
            words[rng.randrange(len(words))] = rng.choice(["vile", "nasty"])
        elif kind == 1:
            words = [x + "###" for x in words]
        texts.append(" ".join(words))
        labels.append((i, int(kind != 1), int(kind == 0)))
    docs = frame(spark, texts + ODD)
    rated = spark.createDataFrame([*labels[:700], (5000, None, None), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = quality_classifier.train(docs, rated)
    got = {r.doc_id: r for r in quality_classifier.classify(docs, model).collect()}
    assert len(got) == len(texts) + len(ODD) and got[0]["size"] == "x"
    unseen = range(700, 900)
    assert np.mean([got[i].kept == (i % 3 == 2) for i in unseen]) > 0.95
    mean = [np.mean([got[i].expected_grade for i in unseen if i % 3 == k]) for k in range(3)]
    assert mean[0] < mean[1] < mean[2]
    assert all(0 <= r.p_good <= r.expected_grade <= 2 for r in got.values())
    single = quality_classifier.train(docs, rated.filter("quality = 1 and toxic = 0"))
    assert all(r.kept for r in quality_classifier.classify(docs, single).collect())
    assert quality_classifier.classify(empty(spark), model).count() == 0


# --- sharding --------------------------------------------------------------------------------------------------------

def test_shard_table():
    names = [f"s{i}" for i in range(20)]
    table = sharding.fill_table(names, 4099)
    held = collections.Counter(table)
    assert max(held.values()) - min(held.values()) <= 1
    fewer = sharding.fill_table(names[:-1], 4099)
    moved = sum(a != b for a, b in zip(table, fewer)) / 4099
    assert moved < 0.25                 # one of twenty shards gone
    with pytest.raises(ValueError):
        sharding.fill_table([])


def test_sharding(spark):
    docs = frame(spark, [*ODD, *[f"t{i}" for i in range(3000)]], ids=[None, *[1] * 500, *range(2509 + len(ODD) - 10)][:3000 + len(ODD)] + [])
    got = sharding.assign_shards(docs, sharding.document_key(), [f"s{i}" for i in range(8)])
    rows = got.collect()
    assert len(rows) == docs.count()
    table = sharding.fill_table([f"s{i}" for i in range(8)])
    for r in rows[:50]:
        key = f"{'' if r.doc_id is None else r.doc_id}|{hashlib.md5((r.text or '').encode()).hexdigest()}"
        slot = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) % sharding.SLOTS
        assert (r.slot, r.shard) == (slot, f"s{table[slot]}")
    per = collections.Counter(r.shard for r in rows)
    assert len(per) == 8 and max(per.values()) < 1.4 * min(per.values())


# --- pipeline --------------------------------------------------------------------------------------------------------

def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    src = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{src}/documents.parquet")
    odd = spark.createDataFrame([(10_000 + i, t, "en", "src0", None if t is None else len(t)) for i, t in enumerate(ODD)], docs.schema)
    docs.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{src}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{i}")
        out = spark.read.parquet(f"{tmp_path}/stage{i}")
        before = {r.doc_id: r for r in now.collect()}
        after = out.collect()
        if i < 4:
            assert out.columns == docs.columns and {r.doc_id for r in after} <= set(before)
        if name == "line dedup":
            want = plain_line_dedup([(k, r.text) for k, r in before.items()], line_dedup.MIN_CHARS, line_dedup.EDITS, line_dedup.PERCENT)
            assert all(r.text == want[r.doc_id] for r in after)
            long = lambda t: any(len(x) >= line_dedup.MIN_CHARS for x in (t or "").split("\n"))
            assert {r.doc_id for r in after} == {k for k, r in before.items() if want[k] == r.text or long(want[k]) or len(want[k]) >= 0.2 * len(r.text)}
        if name == "n-gram Jaccard join":
            ids = list(before)
            parts = plain_components([before[k].text for k in ids], ids, 5, 80)
            assert sorted(r.doc_id for r in after) == sorted(k for k, n, low in parts if k == low)
        if name == "mixing":
            size = lambda t: len((t or "").encode().split())
            times = collections.Counter(r.doc_id for r in after)
            assert max(times.values()) <= 3 and sum(size(r.text) for r in after) > 0.8 * sum(size(r.text) for r in before.values())
        if name == "BPE":
            assert len(after) == now.count() and all(len(r.ids) == 4 * r.n_tokens for r in after)
        now = out
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()
    assert F is not None


@pytest.mark.parametrize("number", range(4))
def test_stages_leave_further_columns_alone(spark, number):
    """Columns that bear the names used inside a stage come back with their values, and the same rows stay."""
    import corpus_pipeline

    src = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{src}/documents.parquet")
    _, stage = corpus_pipeline.STAGES[number]
    wide = docs.select(*docs.columns, *[F.concat_ws("/", F.lit(c), "doc_id").alias(c) for c in INSIDE])
    out = stage(spark, wide, src)
    assert out.columns == wide.columns
    rows = out.collect()
    assert all(r[c] == f"{c}/{r.doc_id}" for r in rows for c in INSIDE)
    assert sorted((r.doc_id, r.text) for r in rows) == sorted((r.doc_id, r.text) for r in stage(spark, docs, src).collect())
