import random

import numpy as np
import pytest

from quarryframe.llm import near_dedup as nd
from quarryframe.llm import substring_dedup as sd
from quarryframe.llm._base import mix64
from quarryframe.llm._components import connected_components
from tests.llm import helpers as hp

DOCS = "doc_id long, text string"


def edited(text, rng, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def near_docs():
    rng = random.Random(8)
    docs = [(i, hp.prose(i, rng.choice([1, 2, 3, 20, 120]), 60)) for i in range(60)]
    bases = [hp.prose(500 + k, 150) for k in range(6)]
    docs += [(100 + i, edited(bases[i % 6], rng, rng.randrange(0, 7))) for i in range(120)]
    docs += [(300, None), (301, ""), (302, "  "), (303, bases[0].upper()), (304, bases[1].replace(" ", "\n"))]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, k, percent):
    docs = near_docs()
    component, sizes = hp.near_components(docs, k, percent)
    got = nd.near_dedup(spark.createDataFrame(docs, DOCS), nd.NearConfig(shingle_words=k, percent=percent)).collect()
    assert {r.doc_id: r.component_id for r in got} == component
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_dedup_odd_rows(odd_docs, no_docs):
    got = nd.near_dedup(odd_docs).collect()
    assert len(got) == 11 and {r.doc_id for r in got if not r.kept} == {5}
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert nd.near_dedup(no_docs).count() == 0


def star(n, seed=21):
    """A base text and spokes with three edits each: alike with the base, not with each other."""
    rng = random.Random(seed)
    base = hp.prose(seed, 150, 10**6).split()
    docs = [(0, " ".join(base))]
    for i in range(1, n + 1):
        w = list(base)
        for k in range(3):
            w[50 * k + rng.randrange(5, 45)] = f"e{rng.randrange(10**9)}"
        docs.append((i, " ".join(w)))
    return docs


@pytest.mark.parametrize("n,rounds", [(100, 5), (400, 5), (400, 0)])
def test_a_star_is_one_component(spark, n, rounds):
    """Spokes meet the base by further orders, and without those by the exact join."""
    got = nd.near_dedup(spark.createDataFrame(star(n), DOCS), nd.NearConfig(shingle_words=3, percent=85, rounds=rounds, exact_rows=0)).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_links_inside_a_common_template_are_found(spark):
    """Texts that share four fifths with all others, and pairs among them that are alike."""
    rng = random.Random(22)
    template = hp.prose(22, 168, 10**6).split()
    docs = []
    for i in range(200):
        own = docs[-1][1].split()[-18:] if i % 4 == 3 else [f"o{rng.randrange(10**9)}" for _ in range(18)]
        docs.append((i, " ".join([*template, *own[:-1], f"z{i}"])))
    component, _ = hp.near_components(docs, 3, 85)
    assert 100 < len(set(component.values())) < 200
    got = nd.near_dedup(spark.createDataFrame(docs, DOCS), nd.NearConfig(shingle_words=3, percent=85)).collect()
    assert {r.doc_id: r.component_id for r in got} == component


def test_scan_covers_or_reports():
    """Each pair with a common prefix of a row's covered depth is compared or in one component, and no other depth is claimed."""
    cfg = nd.NearConfig(percent=85, label_bytes=8, depth=2, region_pairs=1)
    rng = np.random.RandomState(4)
    for turn in range(60):
        rows = sorted(map(tuple, np.column_stack([rng.randint(0, 2, 80), rng.randint(0, 1 + turn % 3, (80, 3)), rng.randint(0, 3, (80, 5))]).tolist()))
        label, comp = np.array(rows, np.uint8), rng.randint(0, 40, 80)
        lo, hi = 7, 71
        common = lambda i, j: int(np.cumprod(label[i] == label[j]).sum()) - 1
        before, after = (8, 8) if turn % 2 else (common(lo - 1, lo), common(hi - 1, hi))
        pairs, lacks, cut = nd.scan(label[lo:hi], comp[lo:hi], np.full(hi - lo, 9), np.zeros(hi - lo, int), before, after, cfg)
        met, lack = {(lo + a, lo + b) for a, b, _ in pairs}, {lo + i: x for i, x, _ in lacks}
        assert len(cut) <= 2 and all(x >= y for _, x, y in lacks)
        assert len(lack) == len(lacks) and len(met) <= (cfg.region_pairs + 1) * (hi - lo)
        for i in range(lo, hi):
            covered = cfg.least**cfg.depth - lack.get(i, 0)
            for j in range(80):
                if i == j or covered < 1e-12 or common(i, j) < round(np.log(covered) / np.log(cfg.least)):
                    continue
                alike = (label[i] == label[j]).sum() - 1 >= nd.least_agreement(8, cfg.least)
                assert lo <= j < hi and ((min(i, j), max(i, j)) in met or comp[i] == comp[j] or not alike)


def test_signature_estimates_similarity():
    cfg = nd.NearConfig()
    rng = np.random.RandomState(1)
    common, a, b = (np.unique(rng.randint(0, 1 << 62, n).astype(np.uint64)) for n in (800, 100, 100))
    constants = nd._pool_constants(cfg)
    x, y = (np.frombuffer(nd.signature(mix64(np.concatenate([common, s])), constants), np.uint8) for s in (a, b))
    assert abs((x == y).mean() - 0.8) < 0.13


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (200, 200), (None, 5)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_compact_windows_equal_brute_force():
    rng = random.Random(3)
    for width in (1, 2, 10, 46):
        rows = [np.array([rng.randrange(1 << 60) if rng.random() < 0.8 else 7 for _ in range(n)], np.uint64) for n in (0, 1, 9, 60, 200)]
        got = sorted(zip(*(x.tolist() for x in sd.compact_windows(rows, width, 12345)), strict=True))
        want = []
        for r, t in enumerate(rows):
            v = [(int(a) >> 24, i) for i, a in enumerate(mix64(t ^ np.uint64(12345)))]
            for c in range(len(v)):
                left = right = c
                while left > 0 and v[left - 1] > v[c]:
                    left -= 1
                while right + 1 < len(v) and v[right + 1] > v[c]:
                    right += 1
                if right - left + 1 >= width:
                    want.append((r, left, c, right))
        assert got == sorted(want)


def test_repeated_passages_cover_brute_force(spark):
    rng = random.Random(9)
    passages = [hp.prose(700 + k, 50 + 7 * k, 10**6) for k in range(8)]
    docs = [(i, hp.prose(i, rng.choice([10, 60, 200]), 10**6)) for i in range(60)]
    planted = set()
    for i in range(100, 160):
        w = hp.prose(i, 150, 10**6).split()
        if i % 3:
            w[40:40] = passages[i % 8].upper().split()
            planted.add(i)
        docs.append((i, " ".join(w)))
    docs += [(200, docs[5][1]), (201, None), (202, "")]
    want = hp.repeated_runs(docs)
    got = {r.doc_id: r for r in sd.repeated_passages(spark.createDataFrame(docs, DOCS)).collect()}
    assert planted <= want and set(got) == want
    for i in planted:
        n = len(passages[i % 8].split())
        assert [(s.start, s.end) for s in got[i].spans] == [(40, 40 + n)] and got[i].n_repeated == n and got[i].partner_ids
    assert all(i not in r.partner_ids for i, r in got.items())


def test_pieces_in_other_texts_hide_no_passage(spark):
    rng = random.Random(11)
    docs, pairs = [], {}
    for g in range(12):
        passage = hp.prose(900 + g, 60, 10**6).split()
        for k in range(10):
            w, at = hp.prose(2000 + 10 * g + k, 300, 10**6).split(), rng.randrange(31)
            w[100:100] = passage if k > 7 else passage[at : at + 30]
            docs.append((10 * g + k, " ".join(w)))
            if k > 7:
                pairs[10 * g + k] = 10 * g + 17 - k
    # the first text has the passage twice
    docs[8] = (8, docs[8][1] + " " + " ".join(docs[8][1].split()[100:160]))
    got = {r.doc_id: r for r in sd.repeated_passages(spark.createDataFrame(docs, DOCS)).collect()}
    assert set(got) == set(pairs) == hp.repeated_runs(docs)
    for i, other in pairs.items():
        assert [(s.start, s.end) for s in got[i].spans] == [(100, 160), (360, 420)][: 1 + (i == 8)] and got[i].partner_ids == [other]


def test_a_common_middle_hides_no_passage(spark):
    """Pairs share an exact run of 53 words, of which the middle 45 stand in 30 other texts each."""
    rng = random.Random(12)
    docs = []
    for g in range(40):
        passage = hp.prose(5000 + g, 53, 10**6).split()
        for k in range(32):
            w = hp.prose(6000 + 40 * g + k, 80, 10**6).split()
            at = rng.randrange(10, 60)
            w[at:at] = passage if k < 2 else passage[4:49]
            docs.append((100 * g + (k + 15) % 32, " ".join(w)))
    want = hp.repeated_runs(docs)
    assert len(want) == 80 and {r.doc_id for r in sd.repeated_passages(spark.createDataFrame(docs, DOCS)).collect()} == want


def test_near_copies_of_a_passage_are_found(spark):
    rng = random.Random(10)
    base = hp.prose(1, 120, 10**6)
    docs = [(i, f"{hp.prose(50 + i, 90, 10**6)} {edited(base, rng, 2)} {hp.prose(90 + i, 30, 10**6)}") for i in range(2)]
    got = {r.doc_id: r for r in sd.repeated_passages(spark.createDataFrame(docs, DOCS)).collect()}
    assert set(got) == {0, 1} and all(r.n_repeated > 100 for r in got.values())


def test_a_piece_in_many_texts_hides_no_similar_passage(spark):
    """Pairs have a passage of 56 words with a word put in in one of them; 30 other texts each have 30 words of one end, and stand first."""
    docs, want = [], set()
    for g in range(12):
        passage = hp.prose(15000 + g, 56, 10**6).split()
        for k in range(32):
            w = hp.prose(16000 + 40 * g + k, 80, 10**6).split()
            piece = passage[:30] if k % 2 else passage[26:]
            w[20 + k : 20 + k] = piece if k < 30 else passage[:28] + ["edit"] * (k - 30) + passage[28:]
            docs.append((100 * g + k, " ".join(w)))
        want |= {100 * g + 30, 100 * g + 31}
    got = {r.doc_id: r for r in sd.repeated_passages(spark.createDataFrame(docs, DOCS)).collect()}
    assert set(got) == want
    assert all(r.n_repeated >= 56 and r.partner_ids == [i ^ 1] for i, r in got.items())


def test_stretch_of_a_passage():
    """The words in a row that are used to find passages are shared by all of them."""
    cfg = sd.PassageConfig()
    assert (cfg.width, cfg.least_shared, cfg.stretch_words, cfg.gram_words, cfg.beside) == (46, 37, 23, 10, 7)


def test_repeated_passages_odd_rows(odd_docs, no_docs):
    got = sd.repeated_passages(odd_docs).collect()
    assert sorted(r.doc_id for r in got) == [3, 3, 4, 5]
    assert sd.repeated_passages(no_docs).count() == 0
