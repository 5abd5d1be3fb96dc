"""Centroid clustering, WARC archives and the source audit against brute force."""

from __future__ import annotations

import gzip
import hashlib
import io
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarryframe.llm import centroid_clusters as cc
from quarryframe.llm.source_audit import AuditConfig, audit_sources
from quarryframe.llm.warc_archive import archive_round_trip, parse_records, read_archives, resolve_revisits, write_archives

from tests.llm.helpers import AZ

# ---- clustering --------------------------------------------------------------------------------------------------------


def plain_clusters(rows, cfg):
    """All distances in Python integers."""
    ok = lambda v: v is not None and len(v) == cfg.dims and all(x is not None and math.isfinite(x) for x in v)
    kept = [(i, [math.floor(cfg.scale * x) for x in v]) for i, v in rows if ok(v)]
    key = lambda r: (hashlib.sha256(f"{cfg.seed}:{r[0]}".encode()).hexdigest(), r[1])
    cents = [v for _, v in sorted((r for r in kept if r[0] is not None), key=key)[: cfg.k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for r in range(cfg.rounds + 1):
        of = [min(range(len(cents)), key=lambda c: (far(v, cents[c]), c)) for _, v in kept]
        if r < cfg.rounds:
            for c in set(of):
                own = [v for (_, v), o in zip(kept, of, strict=True) if o == c]
                cents[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    dist = [far(v, cents[o]) for (_, v), o in zip(kept, of, strict=True)]
    spent = Counter()
    for o, d in zip(of, dist, strict=True):
        spent[o] += d
    name = lambda c: hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()
    return sorted(((i, o, d, spent[o], sum(dist), name(o)) for (i, _), o, d in zip(kept, of, dist, strict=True)), key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance double, inertia string")


@pytest.mark.parametrize("block, leaf", [(2048, 32), (50, 3), (7, 1)])
def test_clusters_equal_brute_force(spark, block, leaf):
    rng = random.Random(block)
    centres = [[rng.uniform(-2, 2) for _ in range(4)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.3) for c in rng.choice(centres)]) for i in range(400)]
    rows += [(1000 + i, [0.25, 0.5, -0.75, 0.0]) for i in range(200)]  # a third of the rows is one vector
    rows += [(5, rows[5][1]), (None, [0.1, 0.2, 0.3, 0.4]), (7001, None), (7002, [1.0]), (7003, [1.0, None, 0.0, 0.0]), (7004, [math.nan, 0.0, 0.0, 0.0]), (7005, [math.inf, 0.0, 0.0, 0.0]), (7006, [])]
    cfg = cc.ClusterConfig(k=9, dims=4, rounds=3, block_vectors=block, leaf_vectors=leaf)
    out, cents = cc.cluster_vectors(vectors(spark, rows), cfg)
    assert sorted((tuple(r) for r in out.collect()), key=str) == plain_clusters(rows, cfg)
    assert len(cents) == 9


def test_clusters_of_few_equal_and_no_vectors(spark):
    cfg = cc.ClusterConfig(k=5, dims=2, rounds=2)
    few = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [4.0, 4.0])]
    assert sorted((tuple(r) for r in cc.cluster_vectors(vectors(spark, few), cfg)[0].collect()), key=str) == plain_clusters(few, cfg)
    out, cents = cc.cluster_vectors(vectors(spark, [(1, None)]), cfg)
    assert out.collect() == [] and len(cents) == 0
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="beyond"):
        cc.cluster_vectors(vectors(spark, [(1, [1e9, 0.0])]), cfg)


def test_filtering_prunes_and_keeps_ties():
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (12, 8))
    points = np.concatenate([centres[i % 12] + rng.integers(-60, 60, (1, 8)) for i in range(1200)])
    tree, order = cc.build_tree(points, 16)
    assert (tree.points == points[order]).all() and (tree.sums[0] == points.sum(axis=0)).all()
    found, whole = np.full(len(points), -1), 0
    for _, a, b, clusters in cc.filter_tree(tree, centres):
        assert (found[a:b] == -1).all()
        found[a:b] = clusters
        whole += (b - a) * (len(clusters) == 1)
    assert (found == cc.squared_distances(tree.points, centres).argmin(axis=1)).all()
    assert whole > 600  # most points are assigned with their node
    # a point between two centroids goes to the smaller number, and equal centroids leave the larger number empty
    pair, _ = cc.build_tree(np.array([[0, 0], [0, 2]]), 1)
    for cents in ([[0, 1], [5, 5], [0, 1]], [[1, 1], [-1, 1], [9, 9]]):
        assert {c for *_, clusters in cc.filter_tree(pair, np.array(cents)) for c in clusters.tolist()} == {0}
    big = np.array([[2**25, -(2**25)], [2**25 - 1, 3]])
    assert cc.squared_distances(big, big).tolist() == [[0, 1 + (2**25 + 3) ** 2], [1 + (2**25 + 3) ** 2, 0]]


# ---- archives ----------------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, record_type string, payload binary, first_id long"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", b"y", 3) for i, u, h in rows], PAGES)


ODD_PAGES = [
    (1, "http://a/1", "<p>" + "x" * 200),
    (9, "http://a/9", "<p>" + "x" * 200),
    (4, None, "<p>" + "x" * 200),
    (None, "http://a/none", "<p>" + "x" * 200),
    (2, "http://a/2 \r\nWARC-Type: evil", "short"),
    (3, "http://a/3", "short"),
    (5, "http://a/5", None),
    (6, "http://a/6", ""),
    (7, "http://é/7", "é\x00\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9),
    (8, "http://a/8", "é\x00\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9),
    (10, "http://a/10", "y" * 300_000),
    (11, "http://a/11", "z" * 100),
    (12, "http://a/12", "z" * 100),
    (13, "http://a/13", "z" * 99),
    (14, "http://a/14", "z" * 99),
    (15, "http://a/15", "r" * 150),
    (15, "http://a/15", "r" * 150),
    (16, "http://a/16", "r" * 150),
]


def plain_archive(rows, least=100):
    body = lambda h: (h or "").encode()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[body(h)] = min(i, first.get(body(h), i))
    out = []
    for i, _, h in rows:
        b = body(h)
        again = len(b) >= least and b in first and first[b] != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=str)


def test_archives_round_trip(spark, tmp_path):
    out = archive_round_trip(pages(spark, ODD_PAGES), f"file://{tmp_path}/w")
    assert out.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == plain_archive(ODD_PAGES)


def test_archives_hold_whole_records(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    write_archives(pages(spark, ODD_PAGES), path, records_per_file=3)
    records = read_archives(spark, path, keep_payload=True).collect()
    got = Counter((r["page_id"], bytes(r["payload"]).decode()) for r in records if r["record_type"] == "response")
    assert got == Counter((i, h or "") for i, _, h in ODD_PAGES if (i, "response") in {(x[0], x[3]) for x in plain_archive(ODD_PAGES)})
    assert {r["target_uri"] for r in records if r["page_id"] == 2} == {"http://a/2%20%0D%0AWARC-Type:%20evil"}
    kept = [r["record_id"] for r in records if r["page_id"] not in (15, None)]
    assert len(set(kept)) == len(kept)
    assert len(list((tmp_path / "w").glob("*.gz"))) >= 6


def test_archives_of_groups_without_ids_and_of_nothing(spark, tmp_path):
    rows = [(None, "u", "q" * 120)] * 3
    assert sorted((tuple(r) for r in archive_round_trip(pages(spark, rows), f"file://{tmp_path}/a").collect()), key=str) == plain_archive(rows)
    assert archive_round_trip(pages(spark, rows).where("false"), f"file://{tmp_path}/b").collect() == []


def test_damaged_archives_are_refused(spark, tmp_path):
    write_archives(pages(spark, ODD_PAGES[:1]).coalesce(1), f"file://{tmp_path}/w")
    [whole] = [gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.gz")]
    for name, data in (("cut", whole[:-20]), ("digest", whole.replace(b"xxxx", b"xxxy", 1)), ("junk", b"hello\r\n"), ("length", re.sub(rb"Content-Length: \d+\r\nPage", b"Page", whole))):
        if name == "length":
            data = re.sub(rb"\r\nContent-Length: \d+\r\n\r\nHTTP", b"\r\n\r\nHTTP", whole)
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(data)
        with pytest.raises(Exception, match="archive|record|digest|length"):
            read_archives(spark, f"file://{tmp_path}/{name}").collect()
    # members for each record, as other writers make them, and a revisit whose response is not there
    lone = b"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Refers-To: <urn:x>\r\nWARC-Payload-Digest: sha256:00\r\nPage-ID: 8\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "members").mkdir()
    (tmp_path / "members" / "a.warc.gz").write_bytes(gzip.compress(whole) + gzip.compress(lone))
    got = resolve_revisits(read_archives(spark, f"file://{tmp_path}/members").drop("payload")).collect()
    assert sorted((r["page_id"], r["record_type"], r["payload_bytes"], r["refers_to"]) for r in got) == [(1, "response", 203, None), (8, "revisit", None, None)]
    assert [f["warc-type"] for f, _ in parse_records(io.BytesIO(whole))] == ["response"]


# ---- source audit ------------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_audit(docs, cfg):
    n, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in ((t or "", x or "", s or "") for t, x, s in docs):
        terms = TERM.findall(text.translate(AZ))
        groups.add((lang, source))
        n[lang, source].update(terms)
        n[lang].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, c in df[lang].items() if c >= cfg.min_docs]
        total = lambda g: sum(n[g][t] for t in kept)
        p = lambda g, t, at: 1 + cfg.unit * (n[g][t] + cfg.smoothing) // (at + cfg.smoothing * len(kept))
        own, whole = total((lang, source)), total(lang)
        parts = {"pair": [(s, sum(abs(p((lang, source), t, own) - p((lang, s), t, total((lang, s)))) for t in kept)) for x, s in groups if x == lang and s != source]}
        gain = [(t, p((lang, source), t, own) - p(lang, t, whole)) for t in kept if n[lang, source][t]]
        parts["term"] = [(t, v) for t, v in gain if v > 0]
        for part, rows in parts.items():
            rows.sort(key=lambda r: (-r[1], r[0].encode()))
            out += [(lang, source, part, item, v, k) for k, (item, v) in enumerate(rows, 1) if part == "pair" or k <= cfg.top_terms]
    return sorted(out)


def audit_docs(seed, n=300):
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None, "d é"]) if i % 3 else "a"
        docs.append((" ".join(rng.choice("Foo foo bar_baz Écran écran x1y don't é😀 W W2 zeta Eta".split()) + str(rng.randrange(3)) * (i % 2) for _ in range(rng.randrange(12))), lang, source))
    rare = [(f"only{k} " * 3, "en", "c") for k in range(40)] * 3  # forty terms with one vector
    return docs + rare + [(None, "en", "empty"), ("", "fr", "x"), ("12 !", "fr", "y"), ("word", "one", "alone")]


@pytest.mark.parametrize("cfg", [AuditConfig(min_docs=3), AuditConfig(min_docs=3, top_terms=4), AuditConfig()])
def test_audit_equals_brute_force(spark, cfg):
    docs = audit_docs(1)
    frame = spark.createDataFrame([(*d, 1, "v", 2) for d in docs], "text string, lang string, source string, n int, term string, value int")
    out = audit_sources(frame, cfg)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in out.collect()) == plain_audit(docs, cfg)


def test_audit_of_odd_and_no_documents(spark, odd_docs, no_docs):
    docs = [(r["text"], r["lang"], r["source"]) for r in odd_docs.collect()]
    cfg = AuditConfig(min_docs=2)
    assert sorted(tuple(r) for r in audit_sources(odd_docs, cfg).collect()) == plain_audit(docs, cfg)
    assert audit_sources(no_docs).collect() == []
