"""Token files, packing, shards, url rules and vector search, and the pipeline."""
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from loomtrace.llm import base, best_fit_packing, components, learned_partitions, quality_rules, sharding, substring_dedup, token_files, tokens, url_filter
from tests.llm import corpus


@pytest.fixture(scope="module")
def table():
    return corpus.rows()


@pytest.fixture(scope="module")
def docs(spark, table):
    return spark.createDataFrame(table, corpus.SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def encoded(table):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokens.vocabulary_path())
    return [(row[0], t.encode(row[1] or "", add_special_tokens=False).ids) for row in table]


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark, docs, encoded, tmp_path):
    got = token_files.digest(docs, str(tmp_path)).collect()
    assert sorted(repr((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got) == sorted(repr((i, len(x) + 1, _crc([*x, 2]))) for i, x in encoded)
    ordered = sorted(got, key=lambda r: r.start)
    at = 0
    for r in ordered:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in ordered]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    folder = next(p for p in tmp_path.iterdir() if p.is_dir())
    assert not [p for p in folder.iterdir() if p.name.startswith(".ids")] and sum(p.stat().st_size for p in folder.glob("ids-*.bin")) == 2 * at
    assert sum(p.stat().st_size // 8 - 1 for p in folder.glob("offsets-*.bin")) == len(got)


def test_token_files_of_nothing(spark, tmp_path):
    assert token_files.digest(spark.createDataFrame([], corpus.SCHEMA), str(tmp_path)).count() == 0


def test_packing_places_every_piece(docs, encoded):
    rows = best_fit_packing.pack(docs, with_ids=True).collect()
    want = Counter()
    for i, x in encoded:
        x = [*x, 0]
        want.update((i, k, s, len(x[s:s + 2048]), _crc(x[s:s + 2048])) for k, s in enumerate(range(0, len(x), 2048)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r.length for r in rows) // 2048) + 1


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan_is_best_fit_decreasing(seed):
    r = np.random.default_rng(seed)
    counts = {int(k): int(r.integers(1, 40)) for k in set(r.integers(1, 65, size=20).tolist())}
    room, free = {}, []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = min((x for x in free if x >= length), default=None)
            free = sorted([*free, 64 - length] if fit is None else [*[x for i, x in enumerate(free) if i != free.index(fit)], fit - length])
    runs = best_fit_packing.plan(counts, 64)
    seen, used = defaultdict(set), defaultdict(list)
    for length, a, b, first, offset in runs:
        assert not seen[length] & set(range(a, b))
        seen[length] |= set(range(a, b))
        for k in range(b - a):
            used[first + k].append((offset, length))
    assert {k: len(v) for k, v in seen.items()} == counts and len(used) == len(free) and not room
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert best_fit_packing.plan({}, 64) == []


def test_packing_of_nothing(spark):
    assert best_fit_packing.pack(spark.createDataFrame([], corpus.SCHEMA)).count() == 0


@pytest.mark.parametrize("per_range", [7, 20_000])
def test_shards_have_equal_rows_and_the_mixture(docs, table, per_range):
    rows = sharding.assign(docs, 6, per_range=per_range).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((t[0], len((t[1] or "").encode()) + 8, zlib.crc32((t[1] or "").encode())) for t in table)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert set(slots) == set(range(6)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    mixed = Counter((r.source, r.shard) for r in rows)
    for source, n in Counter(r.source for r in rows).items():
        assert all(n // 6 - 1 <= mixed[source, s] <= n // 6 + 2 for s in range(6))


def test_shards_run_no_python_and_take_nothing(spark, docs):
    plan = sharding.assign(docs, 4)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert sharding.assign(spark.createDataFrame([], corpus.SCHEMA)).count() == 0


def test_single_row_sources_and_one_source_are_spread(spark, tmp_path):
    schema = "doc_id long, text string, source string, shard string, nth int, range int, key int"
    rows = [(i, f"t{i}", f"only{i}", "x", 1, 2, 3) for i in range(900)] + [(1000 + i, "t", "hot", "x", 1, 2, 3) for i in range(900)] + [(None, None, None, "x", 1, 2, 3)] * 3
    docs = spark.createDataFrame(rows, schema)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        line = sharding.interleave(docs, 7, per_range=50)
        got = line.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert line.columns == ["doc_id", "text", "source", "nth", "range", "key", "shard", "slot"]
    assert Counter((r.doc_id, r.text, r.source, r.key) for r in got) == Counter((r[0], r[1], r[2], r[6]) for r in rows)
    # the same law by sorting everything at once
    of, ranked = Counter(r[2] for r in rows), defaultdict(list)
    for r in rows:
        ranked[r[2]].append((hashlib.md5(f"{sharding.SEED}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0]))
    order = sorted(((2 * k + 1) / (2 * of[s]), "" if s is None else "=" + s, k, d) for s, v in ranked.items() for k, (_, d) in enumerate(sorted(v, key=lambda p: p[0])))
    places = sorted(((r.shard, r.slot, r.doc_id) for r in got), key=lambda p: p[:2])
    assert [p[2] for p in places] == [d for *_, d in order]
    assert max(Counter(r.shard for r in got).values()) - min(Counter(r.shard for r in got).values()) <= 1
    folder = str(tmp_path / "shards")
    sharding.write_shards(docs, folder, 7, per_range=50)
    assert Counter((r.shard, r.slot, r.doc_id) for r in spark.read.parquet(folder).collect()) == Counter((r.shard, r.slot, r.doc_id) for r in got)


PAGES = [(1, "http://a.net/x", '<LINK rel="canonical" href="https://shop.com/de/1?utm_source=q">'), (2, "https://www.shop.com/de/1/", None), (3, "https://a.net/x/#top", ""), (4, "http://b.net/y", '<meta http-equiv="refresh" content="0; url=/z">'),
         (5, "http://b.net/z", "<p>"), (6, "http://c.org/k", '<link href="http://a.net/x" rel="canonical">'), (7, None, "<p>"), (8, "nourl", "x"), (9, "HTTP://Example.ORG/es/a?b#c", "x"), (10, "http://example.org/en/12", "x"),
         (11, "http://x.example.org/en/2", "x"), (12, "http://d.net/q/w", '<link rel="canonical" href="e">'), (13, "http://d.net/q/e", '<meta content="5;URL=http://example.org/es/" http-equiv="Refresh">'), (14, "http://q.com", "x"),
         (14, "http://q.com", "x"), (None, "http://q.com/fr/", "x"), (15, "http://notorg/", ""), (20, "http://e.net/1", "<link href=https://shop.com/de/1 rel=canonical>"), (21, "http://e.net/2", """<meta http-equiv=refresh content="0; url='http://shop.com/de/2'">"""),
         (22, "http://e.net/3", '<link rel="nofollow\n Canonical" data-x="a > b" href="https://shop.com/de/3"/>'), (23, "http://e.net/4", '<link rel=canonical href="http://e.net/t?x=1&amp;y=2">'), (24, "http://e.net/t?x=1&y=2", "<link rel=canonical href=//shop.com/de/4>"),
         (25, "http://e.net/5", """<meta content='say rel="canonical" href="http://shop.com/de/5"'>"""), (26, "http://e.net/6", '<link rel="canonicalish" href="http://shop.com/de/6">'), (27, "http://example.org/es", "x"), (28, "http://e.net/7", "<link" + " data-k='v'" * 5000 + " rel=canonical href=http://shop.com/de/7>"), (16, "", ""), (17, "http://myexample.org/es/", "")]


def test_url_filter_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", PAGES)
    pages = spark.createDataFrame([(*p, "x", "y", 1) for p in PAGES], "page_id long, url string, html string, host string, node string, label int")
    got = url_filter.judge(pages)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "component"]
    rows = got.collect()
    assert corpus.ordered(rows) == corpus.ordered(con.sql(url_filter.SQL).fetchall())
    verdict = {r.page_id: (r.rule, r.verdict) for r in rows}
    assert verdict[1] == (None, "block") and verdict[6] == ("org/", "allow") and verdict[12] == (None, "block") and verdict[5] == (None, "allow") and verdict[10] == ("example.org/en/1", "block") and verdict[15] == (None, "allow")
    assert all(verdict[i] == (None, "block") for i in (20, 21, 22, 23, 24, 28)) and all(verdict[i][1] == "allow" for i in (3, 25, 26, 27))


def test_url_filter_of_nothing(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_components_on_chains_and_stars(spark, tmp_path):
    edges = [(i, i + 1) for i in range(0, 40)] + [(500, i) for i in range(400, 480)] + [(7, 7), (41, 40), (900, 901), (901, 900)]
    got = {r.node: r.label for r in components.label(spark.createDataFrame(edges, "u long, v long"), str(tmp_path)).collect()}
    assert got == {**{i: 0 for i in range(42)}, **{i: 400 for i in range(400, 480)}, 500: 400, 900: 900, 901: 900}


def _vectors():
    r = np.random.default_rng(4)
    centres = r.standard_normal((12, 8)) * 4
    x = [(i, (centres[i % 12] + r.standard_normal(8)).tolist()) for i in range(1500)]
    x += [(2000 + i, x[0][1]) for i in range(300)]  # one very common vector
    x += [(5000, None), (5100, [0.0] * 8), (5200, [float("nan"), *[1.0] * 7]), (5300, [None, *[1.0] * 7]), (5400, [1.0] * 3), (5500, [float("inf"), *[1.0] * 7]), (None, [1.0] * 8), x[1], (100, x[100][1])]
    return [(*v, 1) for v in x]


def test_search_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(learned_partitions, "PER_PART", 100)
    monkeypatch.setattr(learned_partitions, "BLOCK", 64)
    monkeypatch.setattr(learned_partitions, "QUERY_BLOCK", 4)
    table = _vectors()
    rows = learned_partitions.search(spark.createDataFrame(table, "vec_id long, embedding array<double>, part int"), lambda i: i % 50 == 0).collect()
    good = {i: np.array(v) for i, v, _ in table if i is not None and v is not None and len(v) == 8 and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    ids, x = np.array(list(good)), np.stack(list(good.values()))
    got, hit, total = defaultdict(list), 0, 0
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r)
    assert set(got) == {i for i in good if i % 50 == 0}
    for q, found in got.items():
        d = np.sqrt(((x - good[q]) ** 2).sum(axis=1))
        assert [r.rank for r in found] == list(range(1, 11)) and all(r.vec_id != q for r in found)
        assert [(r.score, r.vec_id) for r in found] == sorted((r.score, r.vec_id) for r in found)
        assert all(abs(r.score - np.sqrt(((good[r.vec_id] - good[q]) ** 2).sum())) < 1e-12 for r in found)
        best = [int(ids[i]) for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        hit, total = hit + len(set(best) & {r.vec_id for r in found}), total + 10
    assert hit / total >= 0.9


def test_search_few_and_no_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, -1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in learned_partitions.search(few, lambda i: i % 100 == 0).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert learned_partitions.search(few.filter("vec_id < 0"), lambda i: i % 100 == 0).count() == 0


def test_graph_parts_are_balanced_and_local():
    r = np.random.default_rng(0)
    x = r.standard_normal((800, 3))
    near = learned_partitions.neighbour_graph(x)
    label = learned_partitions.balanced_parts(near, 8, r)
    assert max(np.bincount(label, minlength=8)) <= 111
    assert (label[near] == label[:, None]).mean() > 0.5  # 0.125 by chance


def test_pipeline_stages_follow_their_operators(spark, table, tmp_path):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    rows = [row[:5] for row in table if row[0] is not None]
    docs, kept = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), None
    work = str(tmp_path)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = base.materialize(stage(spark, docs, ""), f"{work}/{k}")
        if k < 4:
            assert docs.columns == names and docs.filter("n_chars <> length(text)").count() == 0
        was, now = [tuple(r)[:2] for r in before.select("doc_id", "text").collect()] if k < 4 else [], [tuple(r) for r in docs.collect()]
        if name == "quality_rules":
            kept = Counter((i, quality_rules.clean(t.encode())[0].decode()) for i, t in was if t and _good(t))
            assert Counter(r[:2] for r in now) == kept
        elif name == "near_dedup":
            groups = {i for i, _, _, good in corpus.near_groups(was) if good}
            assert Counter(r[0] for r in now) == Counter(i for i, _ in was if i in groups)
        elif name == "substring_dedup":
            want = Counter((i, h) for i, _, _, h in corpus.repeats(was))
            assert Counter((r[0], corpus.sha(" ".join(corpus.words(r[1])))) for r in now) == want
        elif name == "packing":
            assert {r[0] for r in now} == {r.doc_id for r in before.collect()}
    assert substring_dedup.WINDOW == 50


def _good(text):
    memo = base.WordHashes()
    n, _, _, _, rep = quality_rules.measures(text.encode(), memo)
    return quality_rules.verdict(n, rep, quality_rules.clean(text.encode())[1])[1]


def test_registered_queries():
    from loomtrace.llm import queries
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.SQL) <= set(queries.QUERIES)
