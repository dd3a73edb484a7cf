import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quirelake.llm import packing, token_counts, token_files, tokens
from quirelake.llm.eliasfano import EliasFano, Shard, pack_shard
from quirelake.llm.scratch import fresh_path


@pytest.fixture(scope="module")
def encode():
    t = Tokenizer.from_file(tokens.default_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_stretches_join_to_whole_texts(fixture_rows, encode):
    tok = tokens.StretchTokenizer(tokens.default_path(), most=50)
    odd = ["a\x1cb", "a b  c", "é x", "...,.. a,. b.,", "İstanbul ǅ ß", "don't, can't. '", "\x00 a", "ｆｕｌｌ １２"]
    for t in [r[1] for r in fixture_rows] + odd:
        assert tok.ids((t or "").encode()).tolist() == encode(t), t


@pytest.mark.parametrize("text", ["hello”,", "x».", "wait…!", "£)", "a–,", "“quoted”. «deux», „drei“; dash—- İ, ก็, слово, 世界! é, e\u0301."])
def test_signs_beyond_ascii_join_those_after_them(encode, text):
    assert tokens.StretchTokenizer(tokens.default_path()).ids(text.encode()).tolist() == encode(text)


@pytest.mark.parametrize(
    "values", [[], [0], [5, 5, 5, 9], list(range(3000)), sorted(np.random.default_rng(0).integers(0, 10**12, 3000).tolist()), [0] * 1500 + [1]]
)
def test_elias_fano(values):
    e = EliasFano.of(np.array(values, np.int64))
    back, end = EliasFano.from_bytes(e.to_bytes(), 0)
    assert end == len(e.to_bytes()) and back.all().tolist() == values and [back.select(i) for i in range(len(values))] == values


def test_elias_fano_is_small():
    v = np.sort(np.random.default_rng(0).integers(0, 2**32, 100_000))
    assert len(EliasFano.of(v).to_bytes()) * 8 / len(v) < 2 + 17 + 0.5


def test_shard():
    s = Shard(pack_shard([None, 3, 3, 9], [1, 2, 0, 3], np.arange(6), 2))
    assert s.doc_ids() == [None, 3, 3, 9] and s.document(3).tolist() == [3, 4, 5] and s.document(2).tolist() == []


@pytest.mark.parametrize("shard_ids", [50, 4_000_000])
def test_round_trip(spark, docs, fixture_rows, encode, shard_ids):
    uri = fresh_path(spark, "t")
    manifest = token_files.write_token_files(docs, uri, tokens.default_path(), shard_ids=shard_ids)
    got = sorted(
        (
            r["start"], -1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_crc32"]
        ) for r in token_files.read_token_files(spark, uri, manifest).collect()
    )
    assert [g[1] for g in got] == sorted(-1 if r[0] is None else r[0] for r in fixture_rows)
    want = sorted((-1 if d is None else d, len(ids := encode(t) + [2]), crc(ids)) for d, t, *_ in fixture_rows)
    assert sorted(g[1:] for g in got) == want
    assert [g[0] for g in got] == np.cumsum([0] + [g[2] for g in got])[:-1].tolist()


def test_token_file_edges(no_docs, clashing):
    assert token_files.token_ids_round_trip(no_docs).count() == 0
    assert token_files.token_ids_round_trip(clashing).count() == clashing.count()


def greedy(word, start, more):
    n, at, pieces = 0, 0, start
    while at < len(word):
        to = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if to is None:
            return -1
        n, at, pieces = n + 1, to, more
    return n


def test_automaton_against_greedy():
    rng = np.random.default_rng(4)
    for _ in range(40):
        make = lambda: {"".join(rng.choice(list("ab"), rng.integers(1, 5))) for _ in range(rng.integers(1, 8))}
        start, more = make(), make()
        m = token_counts.LongestMatch(start, more)
        for _ in range(50):
            w = "".join(rng.choice(list("abc"), rng.integers(1, 12), p=[0.48, 0.48, 0.04]))
            assert m.count(w) == greedy(w, start, more), (w, start, more)


def test_counts_against_greedy(docs, fixture_rows, no_docs, clashing):
    start, more = map(set, token_counts.vocabulary(token_counts.default_path()))
    want = []
    for d, t, *_ in fixture_rows:
        n = [
            greedy("▁" + w.decode(), start, more) if len(w) < 500 else token_counts.LongestMatch(start, more).count("▁" + w.decode()) for w in (t or "").encode().split()
        ]
        want.append((str(d), len(n), sum(max(x, 1) for x in n), n.count(-1)))
    got = [(str(r["doc_id"]), r["n_words"], r["n_pieces"], r["n_unknown"]) for r in token_counts.token_counts(docs).collect()]
    assert sorted(got) == sorted(want)
    assert token_counts.token_counts(no_docs).count() == 0 and token_counts.token_counts(clashing).count() == docs.count()


def pieces(rows):
    out = {}
    for r in rows:
        out.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    return out


def test_packing_is_whole(docs, fixture_rows, encode):
    got = packing.pack(docs, with_ids=True).collect()
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and crc(ids) == r["ids_crc32"]
    assert sorted(seqs) == list(range(len(seqs)))
    for parts in seqs.values():
        parts.sort()
        assert sum(n for _, n in parts) <= 2048 and all(o == sum(n for _, n in parts[:i]) for i, (o, _) in enumerate(parts))
    have = sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got)
    want = []
    for d, t, *_ in fixture_rows:
        ids = encode(t) + [1]
        want += [(str(d), s, len(ids[s : s + 2048]), crc(ids[s : s + 2048]), len(ids)) for s in range(0, len(ids), 2048)]
    assert have == sorted(want)


def test_packing_edges(no_docs, clashing):
    assert packing.pack(no_docs).count() == 0
    assert packing.pack(clashing).select("doc_id").distinct().count() == clashing.select("doc_id").distinct().count()


@pytest.mark.parametrize("n,mean", [(300, 6), (20_000, 6), (5000, 4)])
def test_plan_holds_all_with_little_padding(n, mean):
    rng, sizes = np.random.default_rng(n), packing.classes(2048)
    lengths = np.minimum(2047, rng.lognormal(mean, 1, n).astype(int) + 1)
    size, count = np.unique(sizes[np.searchsorted(sizes, lengths)], return_counts=True)
    plan = packing.plan(dict(zip(size.tolist(), count.tolist(), strict=True)), 2048)
    held = {}
    for pattern, uses in plan:
        assert sum(s * k for s, k in pattern.items()) <= 2048
        for s, k in pattern.items():
            held[s] = held.get(s, 0) + k * uses
    assert held == dict(zip(size.tolist(), count.tolist(), strict=True))
    least = -(-int(size @ count) // 2048)
    assert sum(u for _, u in plan) <= 1.02 * least + 2


def test_column_generation_beats_greedy():
    # thirds and halves that a greedy start mixes badly
    sizes, counts = np.array([700, 1000, 1040, 1348]), np.array([900.0, 500.0, 400.0, 300.0])
    _, first = packing.greedy_patterns(counts, sizes, 2048)
    patterns, uses = packing.column_generation(counts, sizes, 2048, gap=1e-9)
    assert np.allclose(patterns.T @ uses, counts) and (patterns @ sizes <= 2048).all() and uses.sum() <= first.sum() + 1e-9
