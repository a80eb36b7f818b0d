"""Alignment, packing and the audit of sources, against brute force and on awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import align, divergence, packing, queries, segments, textbatch

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, segment string, block long, term string, counts int"
BYTES, PIECES = queries.tokenizer_file("byte_bpe_50k.json"), queries.tokenizer_file("piece_bpe_32k.model")
MIX = [" ", " ", "  ", "\n", "\t", "a", "b", "é", "'s", "’", "“", "1", "\xa0", "　", " ", "\x1c", "᠎", ".", "—", "<|endoftext|>", "中", "👍🏽", " the", "\x85", "\r\n", "​", "\x0b", "<s>", "<0x0A>", "\x00", "ing", "ffi"]


def awkward_rows():
    long = " ".join(f"word{i % 701}" for i in range(6_000))
    return [
        (1, "one two  three\nfour", "en", "s", "x", 1, "t", 1), (1, "one two  three\nfour", "en", "s", "x", 1, "t", 1), (2, None, None, None, None, None, None, None), (3, "", "en", "s", "", 0, "", 0),
        (None, "no id", "en", None, "x", 0, "y", 3), (4, long, "de", "t", "x", 0, "y", 3), (5, long + " ", None, "t", "x", 0, "y", 3), (6, "日本語 é😀 ### \x1c \x00 ▁", "zz", "\U0001f600", "x", 0, "y", 3), (7, " \n\n \t", "en", "s", "x", 0, "y", 3),
        (8, " ", "en", "é", "x", 0, "y", 3), (9, "a▁b", "en", "é", "x", 0, "y", 3), (10, "<|endoftext|> <s>", "en", "é", "x", 0, "y", 3),
    ]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOC)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def mixed(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(MIX) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


class Plain:
    """Alignment of whole texts, without cuts."""

    def __init__(self):
        self.a = Tokenizer.from_file(BYTES)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
        chars = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in chars} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(chars)))}
        self.bytes_a = {i: bytes(byte[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]

    def of(self, text):
        if not text:
            return None
        a, b, whole = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text), (" " + text).encode()
        sa, sb = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b]
        if b"".join(sa) != whole or b"".join(sb) != whole:
            return None
        ea, eb = np.cumsum([len(x) for x in sa]), np.cumsum([len(x) for x in sb])
        groups = [([i for i, e in zip(a, ea) if lo < e <= hi], [i for i, e in zip(b, eb) if lo < e <= hi]) for lo, hi in zip([0, *sorted({*ea} & {*eb})], sorted({*ea} & {*eb}))] if len(a) < 300 else None
        links, at = [], 0
        for i, e, s in zip(a, ea, ea - [len(x) for x in sa]):
            while eb[at] <= s:
                at += 1
            j = at
            while j < len(b) and (eb[j - 1] if j else 0) < e:
                links.append((i, b[j]))
                j += 1
        return a, b, groups, links

    def corpus(self, texts):
        found = [self.of(t) for t in texts]
        count = Counter(p for x in found if x for p in x[3])
        top = defaultdict(int)
        for (_, b), n in count.items():
            top[b] = max(top[b], n)
        out = []
        for x in found:
            if x is None:
                out.append((0, 0, 0, 0, 0, 0, ""))
                continue
            a, b, groups, links = x
            spelt = groups and ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)
            out.append((len(a), len(b), groups and len(groups), len(links), sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links), spelt and hashlib.sha256(spelt.encode()).hexdigest()))
        return out


@pytest.fixture(scope="module")
def plain():
    return Plain()


def check_aligned(rows, texts, plain):
    got = sorted((tuple(r) for r in rows), key=str)
    want = sorted(((i, *x) for (i, _), x in zip(texts, plain.corpus([t for _, t in texts]))), key=str)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda x: (str(x[0]), x[1:3])), sorted(want, key=lambda x: (str(x[0]), x[1:3]))):
        assert all(b is None or a == b for a, b in zip(g, w)), (g, w)  # long texts: brute force leaves groups out


def test_alignment_of_whole_tables(spark, docs, awkward, plain):
    for table in (docs, awkward):
        check_aligned(align.digests(align.align(table, BYTES, PIECES)).collect(), [(r["doc_id"], r["text"]) for r in table.collect()], plain)


def test_alignment_in_small_blocks(spark, plain, monkeypatch):
    monkeypatch.setattr(align, "HOMES", 3)
    texts = list(enumerate(mixed(1500, 5)))
    table = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    check_aligned(align.digests(align.align(table, BYTES, PIECES, block_chars=700)).collect(), texts, plain)


def test_pairs_beyond_what_a_task_holds(spark, plain, monkeypatch):
    texts = list(enumerate(mixed(300, 6)))
    monkeypatch.setattr(align, "MANY_PAIRS", 10)
    for wide in (5, 10**6):
        monkeypatch.setattr(align, "WIDE", wide)
        check_aligned(align.digests(align.align(spark.createDataFrame(texts, "doc_id long, text string"), BYTES, PIECES)).collect(), texts, plain)


def test_numbers_survive_packing():
    for x in ([], [0], [5, 2**32 - 1, 0, 7] * 100):
        assert align.unpacked(align.packed(np.array(x, np.uint32))).tolist() == x


def test_groups_are_texts_of_ids(spark):
    table = spark.createDataFrame([(1, "naïve aligning")], "doc_id long, text string")
    row = align.align(table, BYTES, PIECES).first()
    a = [int(i) for g in row["groups"].split(";") for i in g.split("|")[0].split(",")]
    own = Tokenizer.from_file(BYTES)
    assert own.decode(a) == " naïve aligning" and len(a) == row["n_a"]


def test_alignment_of_no_rows(empty):
    assert align.align(empty, BYTES, PIECES).count() == 0


def test_cut_keeps_what_either_vocabulary_makes():
    own = align.aligner(BYTES, PIECES)
    for text in mixed(3000, 7):
        if text and "▁" not in text:
            parts = align.cut(" " + text)
            assert [i for x in own.ids_b(parts) for i in x] == own.b.encode(text)
            assert [i for x in parts for i in own.a.encode(x, add_special_tokens=False).ids] == own.a.encode(" " + text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(), min_size=1, max_size=4))
def test_segments_encode_any_text(texts):
    own, lib = segments.encoder(BYTES, 2), Tokenizer.from_file(BYTES)
    got = [x for _, _, w in textbatch.chunks(pa.array(texts, pa.large_string()), fold=False) for ids, n in [own.ids(w)] for x in np.split(ids, np.cumsum(n)[:-1])]
    assert [x.tolist() for x in got] == [lib.encode(t, add_special_tokens=False).ids + [2] for t in texts]


def test_refuses_other_tokenizers():
    with pytest.raises(ValueError):
        segments.load(queries.tokenizer_file("word_bpe_49k.json"), plain=False)


def test_segments_of_mixed_texts():
    texts, own, lib = mixed(5000, 8), segments.SegmentEncoder(BYTES, 2), Tokenizer.from_file(BYTES)
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [x.ids + [2] for x in lib.encode_batch(texts, add_special_tokens=False)]


def check_packed(rows, texts, capacity, encode):
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    want = defaultdict(list)
    for i, t in texts:
        ids = encode(t)
        n = -(-len(ids) // capacity)
        cuts = [0, *[len(ids) - (n - k) * capacity for k in range(1, n)], len(ids)]
        want[i] += [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert {i: sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in x) for i, x in by_doc.items()} == {i: sorted(x) for i, x in want.items()}
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in sequences.values():
        x.sort()
        ends = np.cumsum([n for _, n in x])
        assert [a for a, _ in x] == [0, *ends[:-1]] and ends[-1] <= capacity
    return len(sequences), sum(r["length"] for r in rows)


def test_packing(spark, docs, awkward):
    lib = Tokenizer.from_file(BYTES)
    encode = lambda t: lib.encode(t or "", add_special_tokens=False).ids + [2]
    for table, capacity in ((docs, 1024), (docs, 64), (awkward, 50), (awkward, 1)):
        rows = packing.places(packing.sequences(table.repartition(3), BYTES, 2, capacity)).collect()
        used, tokens = check_packed(rows, [(r["doc_id"], r["text"]) for r in table.collect()], capacity, encode)
        if capacity == 64:
            assert used <= -(-tokens // capacity) + 3


def test_packing_of_no_rows(empty):
    assert packing.places(packing.sequences(empty, BYTES, 2)).count() == 0


def best_subset(left, room):
    return max(s for s in _sums(left) if s <= room)


def _sums(left):
    sums = {0}
    for x, n in left.items():
        sums = {s + x * k for s in sums for k in range(n + 1)}
    return sums


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), st.integers(0, 60))
def test_fullest_combination(left, room):
    chosen = packing.fullest(left, room)
    assert all(0 < n <= left[x] for x, n in chosen.items())
    assert sum(x * n for x, n in chosen.items()) == best_subset(left, room)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 50), max_size=12))
def test_bins_take_every_piece_once(count):
    plan = packing.bins(count, 40)
    taken = Counter()
    for own, times in plan:
        assert sum(x * n for x, n in own.items()) <= 40
        for x, n in own.items():
            taken[x] += n * times
    assert taken == Counter(count)
    slots = packing.Slots(plan)
    found = set()
    for x, n in count.items():
        for s, o in zip(*slots.find(np.full(n, x), np.arange(n))):
            assert o + x <= 40 and s < slots.sequences
            assert found.isdisjoint({(s, k) for k in range(o, o + x)})
            found |= {(s, k) for k in range(o, o + x)}


def test_bins_against_first_fit_decreasing():
    rnd = random.Random(3)
    for _ in range(30):
        sizes = [min(100, 1 + int(rnd.expovariate(1 / 30))) for _ in range(300)]
        fit = []
        for x in sorted(sizes, reverse=True):
            at = next((i for i, used in enumerate(fit) if used + x <= 100), None)
            if at is None:
                fit.append(x)
            else:
                fit[at] += x
        assert sum(t for _, t in packing.bins(Counter(sizes), 100)) <= len(fit)


def least_bins(count, capacity):
    """Martello and Toth's lower bound: pieces longer than half a bin stand apart, and what is left over fills their gaps."""
    best = 0
    for k in range(capacity // 2 + 1):
        alone = sum(n for x, n in count.items() if x > capacity - k)
        wide = {x: n for x, n in count.items() if capacity / 2 < x <= capacity - k}
        rest = sum(x * n for x, n in count.items() if k <= x <= capacity / 2)
        gaps = sum((capacity - x) * n for x, n in wide.items())
        best = max(best, alone + sum(wide.values()) + max(0, -(-(rest - gaps) // capacity)))
    return best


def test_bins_of_a_large_corpus_are_few():
    rnd = np.random.default_rng(1)
    count = dict(enumerate((rnd.random(1024) * 1e11).astype(int).tolist(), 1))
    plan = packing.bins(count, 1024)
    assert len(plan) < 20_000 and sum(t for _, t in plan) <= 1.0005 * least_bins(count, 1024)


def brute_audit(rows, least, top):
    words = lambda t: ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    rows = [(a or "", b or "", words(t)) for a, b, t in rows]
    out = []
    for lang in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == lang]
        in_docs = Counter(w for x in own for w in set(x[2]))
        kept = [w for w, n in in_docs.items() if n >= least]
        sources = sorted({x[1] for x in own})
        count = {s: Counter(w for x in own if x[1] == s for w in x[2] if in_docs[w] >= least) for s in sources}
        every = sum(count.values(), Counter())
        share = lambda c, w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept))
        for s in sources:
            pairs = [(sum(abs(share(count[s], w) - share(count[o], w)) for w in kept), o) for o in sources if o != s]
            terms = [(share(count[s], w) - share(every, w), w) for w in kept if count[s][w] and share(count[s], w) > share(every, w)]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, n) for n, (v, i) in enumerate(found[:most], 1)]
    return sorted(out)


def test_divergence(docs, awkward, empty):
    for table, least in ((docs, 30), (docs, 3), (awkward, 1), (awkward, 2)):
        rows = [(r["lang"], r["source"], r["text"]) for r in table.collect()]
        assert sorted(tuple(r) for r in divergence.audit(table, least=least, top=7).collect()) == brute_audit(rows, least, 7)
    assert divergence.audit(empty).count() == 0


def test_divergence_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.op12_source_divergence(spark, SF)
    assert sorted(tuple(r) for r in got.collect()) == sorted(c.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.OP12_SQL})").fetchall())


def test_shares_are_whole_numbers_of_large_counts(spark):
    rows = [(5, 10), (7, 7), (10**13 + 3, 3 * 10**13 + 1), (1, 8 * 10**15)]
    got = spark.createDataFrame(rows, "a long, b long").select(divergence.share(divergence.F.col("a"), divergence.F.col("b")).alias("x")).collect()
    assert [r["x"] for r in got] == [1 + 10**9 * a // b for a, b in rows]
