"""Corpus operators on texts against plain-Python versions, with nulls, empties, repeats and clashing columns."""
import zlib

import numpy as np
import pyarrow as pa
import pytest

from loomtrace.llm import base, bpe, line_dedup, minhash, quality_rules, substring_dedup, tokens
from tests.llm import corpus


@pytest.fixture(scope="module")
def table():
    return corpus.rows()


@pytest.fixture(scope="module")
def docs(spark, table):
    return spark.createDataFrame(table, corpus.SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], corpus.SCHEMA)


def test_rolling_hash_tells_every_window_apart():
    x = np.arange(1, 400, dtype=np.uint64) % np.uint64(7)
    for width in (1, 2, 3, 5, 25, 50):
        h = base.rolling(x, width)
        seen = {}
        for i in range(len(x) - width + 1):
            assert seen.setdefault(tuple(x[i:i + width]), h[i]) == h[i]
        assert len(set(seen.values())) == len(seen)
    assert len(base.rolling(x[:3], 4)) == 0


def test_pack_and_planes_round_trip():
    a, b = np.array([0, 5, 70000, 70001]), np.array([], np.uint64)
    planes, none = base.unpack(base.pack(base.to_planes(a), b))
    assert base.from_planes(planes).tolist() == a.tolist() and len(none) == 0


def test_substring_dedup_equals_brute_force(docs, table):
    assert corpus.ordered(substring_dedup.digest(docs).collect()) == corpus.ordered(corpus.repeats(table))


def test_substring_dedup_with_small_batches_and_windows(docs, table, monkeypatch):
    got = substring_dedup.digest(docs, window=12)
    assert corpus.ordered(got.collect()) == corpus.ordered(corpus.repeats(table, 12))


def test_substring_remove_cuts_words_and_keeps_columns(docs, table):
    out = substring_dedup.remove(docs).collect()
    assert len(out) == len(table) and list(out[0].asDict()) == docs.columns
    want = sorted(repr((i, h)) for i, _, _, h in corpus.repeats(table))
    assert sorted(repr((r.doc_id, corpus.sha(" ".join(corpus.words(r.text))))) for r in out) == want
    changed = {i for i, _, n, _ in corpus.repeats(table) if n}
    whole = {row[0]: row[1] for row in table}
    assert all(r.text == whole[r.doc_id] for r in out if r.doc_id is not None and r.doc_id not in changed)


def test_quality_rules_equal_their_sql(docs, table):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [row[:2] for row in table])
    assert corpus.ordered(quality_rules.digest(docs).collect()) == corpus.ordered(con.sql(quality_rules.SQL).fetchall())


@pytest.mark.parametrize(("line", "fails"), [
    ("A plain sentence that ends well.", False), ("He said so.”", False), ("It ends. well", False), ("No mark at the end of it", True), ("Home | News | About | Login.", True),
    ("Win!! Big!! Prize!! now.", True), ("so so so so so so end.", True), ("We use a Cookie Policy here.", True), ("Please read our privacy policy and terms of use before you go.", True),
    ("The board read the privacy policy aloud, argued about it for an hour and voted to put it off until the spring.", False), ("यह एक वाक्य है।", False), ("هل هذا سؤال؟", False), ("Սա նախադասություն է։", False), ("a# b# c# d.", True), ("f(x) | y is a pipe in prose, once or twice | maybe, and it goes on and on.", False)])
def test_line_rules(line, fails):
    assert quality_rules.line_fails(line.encode(), line.encode().split()) is fails


def test_clean_one_line_document_that_mentions_a_phrase_stays(spark):
    prose = " ".join(f"word{k}" for k in range(80)) + " about the privacy policy of the house."
    rows = spark.createDataFrame([(1, prose), (2, "। ".join(f"शब्द{k} वाक्य" for k in range(60)) + "।")], "doc_id long, text string")
    assert [(r.n_lost, r.kept) for r in quality_rules.digest(rows).orderBy("doc_id").collect()] == [(0, True), (0, True)]


def test_quality_filter_drops_lines_and_documents(docs, table):
    kept = {repr(r.doc_id) for r in quality_rules.digest(docs).filter("kept").collect()}
    out = quality_rules.filter_documents(docs).collect()
    assert {repr(r.doc_id) for r in out} == kept and list(out[0].asDict()) == docs.columns
    menu = quality_rules.clean(b"| a | b | c |\nHome | News | About | Contact\nA line that stays.")
    assert menu == (b"A line that stays.", 14)


def test_minhash_groups_equal_brute_force(docs, table):
    assert corpus.ordered(minhash.label(docs).collect()) == corpus.ordered(corpus.near_groups(table))


def test_minhash_keep_one(docs, table):
    want = {i for i, _, _, kept in corpus.near_groups(table) if kept}
    out = minhash.keep_one(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == want


def test_minhash_crosses_components_in_blocks(spark, monkeypatch):
    """A chain of near copies whose ends are far from the first: found only beyond the star."""
    r = np.random.default_rng(1)
    word = [f"w{i}" for i in range(400)]
    chain = []
    for _ in range(12):
        chain.append(" ".join(word))
        for _ in range(9):
            word[r.integers(400)] = f"n{r.integers(1 << 30)}"
    table = [(100 - i, t) for i, t in enumerate(chain)] + [(200 + i, " ".join(f"z{j % (17 + i)}" for j in range(300))) for i in range(5)]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    monkeypatch.setattr(minhash, "BLOCK", 3)
    assert corpus.ordered(minhash.label(docs).collect()) == corpus.ordered(corpus.near_groups(table))


def test_minhash_pairs_of_long_texts_leave_one_bucket():
    """Every surviving pair that shares a band leaves exactly one bucket, also where the minima of large sets have equal top bits."""
    r = np.random.default_rng(5)
    met = 0
    for _ in range(24):
        word = [f"w{i}" for i in range(20000)]
        texts = [" ".join(word)]
        for i in r.integers(20000, size=560):
            word[i] = f"n{i}"
        texts.append(" ".join(word))
        rows = pa.RecordBatch.from_pylist([{"doc_id": i, "key": i, "text": t} for i, t in enumerate(texts)])
        a, b = pa.Table.from_batches(minhash._sign(iter([rows]))).to_pylist()
        if not len(minhash._survive(*(np.frombuffer(x["sig"], "<u2").reshape(1, -1) for x in (a, b)))[0]):
            continue
        left = 0
        shared = [k for k in range(minhash.BANDS) if a["bands"][k] == b["bands"][k]]
        for k in shared:
            rows = [{"bucket": 1, "lo": 0, "hi": 0, "node": i, "label": i, "band": k, "side": 2, "sig": x["sig"], "bands": x["bands"]} for i, x in enumerate((a, b))]
            left += sum(out.num_rows for out in minhash._screen(iter([pa.RecordBatch.from_pylist(rows)]))) // 2
        assert left == (len(shared) > 0)
        met += left
    assert met > 15


def test_minhash_one_id_with_two_texts_links_both(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    table = [(1, a), (1, b), (5, a + " more"), (6, b + " more"), (7, "else " + a.replace("a", "q")), (7, b), (8, " ".join(f"h{i}" for i in range(9)))]
    got = {(r.doc_id, r.component_id) for r in minhash.label(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (5, 1), (6, 1), (7, 1), (8, 8)}


def test_minhash_a_group_leaves_its_block_as_a_forest(spark):
    """All pairs of a group survive, some of them are no links: fewer links than members come out, and they join what brute force joins."""
    r = np.random.default_rng(2)
    whole, texts = [f"w{i}" for i in range(300)], []
    for _ in range(90):
        w = list(whole)
        for i in r.integers(300, size=r.integers(1, 12)):
            w[i] = f"n{r.integers(1 << 30)}"
        texts.append(" ".join(w))
    signed = pa.Table.from_batches(minhash._sign(iter([pa.RecordBatch.from_pylist([{"doc_id": i, "key": i, "text": t} for i, t in enumerate(texts)])]))).to_pylist()
    rows = [{"bucket": 1, "lo": 0, "hi": 0, "node": i, "label": i, "side": 2, "sig": x["sig"], "text": t} for i, (x, t) in enumerate(zip(signed, texts, strict=True))]
    cut = [pa.RecordBatch.from_pylist(rows[i:i + 7]) for i in range(0, 90, 7)]
    links = pa.Table.from_batches(minhash._forest(iter(cut))).to_pylist()
    want = {i: c for i, _, c, _ in corpus.near_groups(list(enumerate(texts)))}
    up = {i: i for i in want}
    for x in links:
        assert want[x["u"]] == want[x["v"]]
        a, b = up[x["u"]], up[x["v"]]
        assert a != b
        up = {k: (a if v == b else v) for k, v in up.items()}
    assert len(set(up.values())) == len(set(want.values())) and 0 < len(links) < 90


def test_short_values_of_large_sets_differ():
    r = np.random.default_rng(6)
    x, y = (np.frombuffer(minhash._short(minhash.signature(r.integers(0, 1 << 63, 200_000, np.uint64))), "<u2") for _ in range(2))
    assert (x == y).sum() <= 2  # sets without a common element


def test_pruning_bound_keeps_the_threshold():
    assert minhash.least_matches(32) < 24 and minhash.least_matches(160) < 120
    assert [minhash.least_matches(n) for n in (32, 64, 96, 128, 160)] == sorted(minhash.least_matches(n) for n in (32, 64, 96, 128, 160))


@pytest.mark.parametrize(("a", "b", "want"), [
    ([1, 2, 3], [1, 2, 3], [(0, 0), (1, 1), (2, 2)]), ([], [1], []), ([1, 9, 2, 3], [1, 8, 2, 3], [(0, 0), (2, 2), (3, 3)]), ([5, 1, 2, 6], [7, 2, 8, 1, 9], [(1, 3)]), ([4, 4], [4], [(0, 0)]), ([1, 1, 2], [3, 1, 1], [])])
def test_patience(a, b, want):
    got = sorted(line_dedup.patience(a, b))
    assert len(got) == len(want) and all(a[i] == b[j] for i, j in got)
    assert got == want or a == [5, 1, 2, 6]


def _lines_left(table):
    """Brute force: every document against every earlier holder by the same rules."""
    keyed = sorted({(row[0], row[1]) for row in table if row[0] is not None and corpus.words(row[1])}, key=lambda p: p[0])
    strip = lambda t: [x.strip(" \t\r\x0b\x0c") for x in t.split("\n")]
    seqs, reps, gone = {}, [], {}
    for i, t in keyed:
        seq = tuple(x for x in strip(t) if x)
        if seq in seqs:
            gone[i] = None
        else:
            seqs[seq] = i
            reps.append((i, list(seq)))
    def anchors(seq):
        """Every anchor with its places: long lines, and shortest runs of two lines or more that reach the words."""
        found: dict = {}
        for p, x in enumerate(seq):
            if len(x.split()) >= line_dedup.LINE_WORDS:
                found.setdefault((x,), []).append([p])
            for q in range(p + 2, len(seq) + 1):
                if len(" ".join(seq[p:q]).split()) >= line_dedup.PAIR_WORDS:
                    found.setdefault(tuple(seq[p:q]), []).append(list(range(p, q)))
                    break
        return found

    lines, of = dict(reps), {i: anchors(seq) for i, seq in reps}
    for b, seq in reps:
        for k, places in of[b].items():
            a = next(i for i, _ in reps if k in of[i])
            if a >= b:
                continue
            gone.setdefault(b, set()).update(j for _, j in line_dedup.patience(lines[a], seq))
            if len(places) == 1:
                gone[b].update(places[0])
    out = []
    for row in table:
        text = row[1] or ""
        full = [n for n, x in enumerate(strip(text)) if x]
        drop = gone.get(row[0], set()) if row[0] is not None else set()
        drop = set(range(len(text.split("\n")))) if drop is None else {full[j] for j in drop}
        kept = [x for n, x in enumerate(text.split("\n")) if n not in drop]
        left = sum(bool(x.strip()) for x in kept)
        out.append((row[0], len(full), len(full) - left, corpus.sha("\n".join(kept) if left or not drop else "")))
    return out


def test_line_dedup_equals_brute_force(docs, table):
    want = _lines_left(table)
    assert sum(r[2] > 0 for r in want) >= 8
    assert corpus.ordered(line_dedup.digest(docs).collect()) == corpus.ordered(want)


def test_line_dedup_remove_drops_emptied_documents(docs, table):
    want = sorted(repr(r[0]) for r in _lines_left(table) if not r[1] or r[1] > r[2])
    out = line_dedup.remove(docs)
    assert out.columns == docs.columns and sorted(repr(r.doc_id) for r in out.collect()) == want


def _left(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    return {r.doc_id: r.n_lines - r.n_removed for r in line_dedup.digest(docs).collect()}


def test_line_dedup_does_not_depend_on_the_number_of_holders(spark):
    """A frequent line beside a short one goes with it, and alone, for 3 holders as for 65."""
    for n in (3, 64, 65):
        frequent = "a line that very many documents hold"
        texts = ["\n".join([f"own head of document {i} here", "ok", frequent, f"own tail of document {i} here"]) for i in range(n)]
        left = _left(spark, texts)
        assert left[1] == 4 and {left[i] for i in range(2, n + 1)} == {2}


def test_line_dedup_sends_a_frequent_holder_in_parts(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "PER_TASK", 3)
    texts = ["\n".join(["the line that all of them share", f"own {i} words of this document"]) for i in range(40)]
    left = _left(spark, texts)
    assert left.pop(1) == 2 and set(left.values()) == {1}


def test_line_dedup_meets_later_holders(spark):
    """The earliest holder cannot align the line, another one can: a repeated line, and an index page in another order."""
    x, *s = [f"line {i} of several words here" for i in range(40)]
    index = [f"{s[0]}", s[9], s[8], s[7], s[6], s[5], f"{s[1]}"]
    texts = ["\n".join(t) for t in ([s[10], x, s[11], x, s[12]], [s[13], x, s[14]], [s[15], x, s[16]], index, [s[17], *s[5:10], s[18]], [s[19], *s[5:10], s[20]],
                                     [s[21], x, s[22], x, s[23]])]
    left = _left(spark, texts)
    assert left[3] == 2 and left[6] == 2 and left[7] == 5


def test_line_dedup_tries_every_holder(spark):
    """Seven holders with the shared lines in an order of their own come before the one that aligns."""
    p, q = "first line of five words", "second line of five words"
    texts = ["\n".join([f"own head of holder {i} x", q, f"own middle of holder {i} x", p, f"own tail of holder {i} x"]) for i in range(7)]
    texts = [*(t.replace(q, "\n".join([q, "mid line of five words", q])) for t in texts), f"a lone head of words\n{p}\nmid part of five words\n{q}\na lone tail of words",
             f"b lone head of words\n{p}\nother mid of five words\n{q}\nb lone tail of words"]
    assert _left(spark, texts)[9] == 3


def test_line_dedup_has_no_cut_for_frequent_or_short_lines(spark):
    """A passage in one line goes whatever the number of its holders; lists of short lines meet."""
    passage = " ".join(f"p{i}" for i in range(60))
    n = 70
    texts = [f"own head number {i} of words\n{passage}\nown tail number {i} of words" for i in range(n)]
    verse = [f"item {i}" for i in range(30)]
    texts += ["\n".join(verse), "\n".join([*verse[:12], "changed", *verse[13:]])]
    left = _left(spark, texts)
    assert left[1] == 3 and {left[i] for i in range(2, n + 1)} == {2}
    assert left[n + 1] == 30 and left[n + 2] == 1


def test_runs_are_the_shortest_that_reach_the_words():
    f = np.array([11, 12, 13, 14, 15, 16], np.uint64)
    at, _, reach = line_dedup._runs(f, np.array([12, 1, 4, 5, 2, 2]))
    assert (at.tolist(), reach.tolist()) == ([0, 1, 2], [2, 3, 3])
    assert len(line_dedup._runs(f[:1], np.array([30]))[0]) == 0


def test_bpe_equals_the_library(docs, table):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokens.vocabulary_path())
    want = []
    for row in table:
        ids = t.encode(row[1] or "", add_special_tokens=False).ids
        want.append((row[0], len(ids), corpus.sha(" ".join(map(str, ids))), corpus.sha(t.decode(ids, skip_special_tokens=False))))
    assert corpus.ordered(bpe.digest(docs).collect()) == corpus.ordered(want)
    encoded = bpe.encode_documents(docs)
    assert encoded.filter("size(ids) = 0").count() == sum(not len(t.encode(row[1] or "").ids) for row in table)
    got = bpe.decode_documents(encoded).collect()
    assert sorted(repr((r.doc_id, corpus.sha(r.text))) for r in got) == sorted(repr((w[0], w[3])) for w in want)


def test_bpe_scan_and_heap_merge_alike():
    b = bpe.codec(tokens.vocabulary_path())
    r = np.random.default_rng(2)
    for n in (1, 2, 7, 60, 400):
        for letters in ("ab", "aeinorst", "thelowing"):
            raw = "".join(letters[i] for i in r.integers(len(letters), size=n)).encode()
            parts = [*(b.inner[x] for x in raw[:-1]), b.last[raw[-1]]]
            assert b._scan(parts) == b._heap(parts)


def test_chunked_encoding_equals_whole_texts(table):
    e = tokens.Encoder(tokens.vocabulary_path())
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokens.vocabulary_path())
    e.words.limit = 50  # the memo changes generation in between
    for row in table:
        want = t.encode(row[1] or "", add_special_tokens=False).ids
        got = e.ids(None if row[1] is None else row[1].encode(), 2)
        assert got.tolist() == [*want, 2] and tokens.crc32(got) == zlib.crc32(np.array([*want, 2], "<u4").tobytes())


def test_empty_tables_give_empty_results(nothing):
    for f in (substring_dedup.digest, substring_dedup.remove, quality_rules.digest, quality_rules.filter_documents, minhash.label, minhash.keep_one, line_dedup.digest, line_dedup.remove, bpe.digest):
        assert f(nothing).count() == 0


def test_batches_of_texts_equal_single_texts(table):
    e = tokens.Encoder(tokens.vocabulary_path())
    texts = [row[1] for row in table] + ["", None, "  ", "É;; ÀÉ.x ÿ Ÿ ß ẞ µm Ω İi ΑΣ. á é.", "don't stop.", " x\x1cy \x85 z", "a,b.c;", "\n.\n,"]
    ids, bounds = e.batch(pa.array([None, *texts]).slice(1), 0)
    assert len(bounds) == len(texts) + 1 and bounds[0] == 0
    for k, t in enumerate(texts):
        want = tokens.tokenizer(tokens.vocabulary_path()).encode(t or "", add_special_tokens=False).ids
        assert ids[bounds[k]:bounds[k + 1]].tolist() == [*want, 0]
    assert [len(x) for x in e.batch(pa.array([], pa.string()), 0)] == [0, 1]
