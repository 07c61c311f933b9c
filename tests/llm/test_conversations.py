"""Repair of turns and the prefix trie, against brute force."""
import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest

from loomtrace.llm import prefix_trie, turn_repair

SCHEMA = "conv_id long, turn long, role string, text string, there boolean, nth long, shard long"


def _conversations(seed=1):
    r = random.Random(seed)
    rows = []
    for c in range(140):
        conv = c * 7 - 30
        n = r.randint(1, 9)
        opening = r.random() < 0.3
        for t in range(n):
            role = "system" if t == 0 and opening else "user" if (t + opening) % 2 == 0 else "assistant"
            if r.random() < 0.06:
                role = r.choice(["tool", "", None, "user", "assistant", "System"])
            text = r.choice(["yes.", "no!", "Hello there", "so?\n", "a \t b.", " ", "", None, f"turn {t}. of {r.randint(0, 3)}."])
            rows.append((conv, None if r.random() < 0.03 else t * r.choice([1, 1, 1, 2]), role, text))
    rows += [rows[5], rows[5], (None, 0, "user", "x."), (None, 1, "assistant", None), (None, None, None, None), (10 ** 12, 9, "user", "é ü.")]
    return rows


def _damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        out[conv]
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(f"{len(x[1].encode())}:{x[1]}{x[2]}".encode()).hexdigest())
    return {c: sorted(v, key=key) for c, v in out.items()}


def _best(turns):
    """All edit sequences by memoised search over (turn, state); state: role initials so far matter only by their end."""
    faults, seen = [], set()
    for _, role, text in turns:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def go(i, end, inserted):
        options = []
        if i == len(turns) and end in ("", "a"):
            options.append((0, "", ()))
        if i < len(turns):
            cost, audit, kept = go(i + 1, end, 0)
            options.append((3 + cost, "D" + audit, kept))
            role, fault = turns[i][1], faults[i]
            if fault not in ("blank", "duplicate"):
                for new, price, name in [(role, 0, "K"), ("user", 2, "R"), ("assistant", 2, "R")]:
                    initial = new[:1]
                    if initial and (end + initial) in ("s", "u", "su", "ua", "au") and (initial != "s" or name == "K"):
                        cost, audit, kept = go(i + 1, initial, 0)
                        options.append((price + (fault == "truncated") + cost, name + audit, ((new, turns[i][2]), *kept)))
        if inserted < 3:
            for new in ("user", "assistant"):
                if (end + new[0]) in ("u", "su", "ua", "au"):
                    cost, audit, kept = go(i, new[0], inserted + 1)
                    options.append((2 + cost, "I" + audit, ((new, ""), *kept)))
        return min(options, default=(10 ** 9, "", ()))

    return faults, go(0, "", 0)


def test_repair_equals_search_over_all_edits(spark):
    rows = _conversations()
    df = spark.createDataFrame([(*r, False, 3, 4) for r in rows], SCHEMA).repartition(4)
    got = {r.conv_id: r for r in turn_repair.digest(df).collect()}
    want = _damaged(rows)
    assert set(got) == set(want)
    for conv, turns in want.items():
        faults, (cost, audit, kept) = _best(turns)
        dated = [t for t, _, _ in turns if t is not None]
        gaps = max(dated) - min(dated) + 1 - len(set(dated)) if dated else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        sha = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in kept).encode()).hexdigest()
        r = got[conv]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha), conv


@pytest.mark.parametrize("seed", range(6))
def test_tables_of_each_length_equal_the_folded_table(seed):
    r = random.Random(seed)
    for _ in range(150):
        codes = bytes(r.choice([0, 1, 2, 1, 2, 3, 9, 10, 5, 6, 8]) for _ in range(r.randint(0, 14)))
        assert turn_repair._cheapest(codes) == turn_repair._folded(codes)


def test_a_very_long_conversation_is_one_stream(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"line {t}.", True, 0, 0) for t in range(5000)]
    got = turn_repair.digest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 1 and got[0].cost > 0 and len(got[0].audit) >= 4900


def test_repaired_turns_and_nothing(spark):
    rows = [(1, 0, "assistant", "Hi.", True, 0, 0), (1, 1, "assistant", "Yes.", True, 0, 0), (1, 2, "user", "", True, 0, 0), (2, 0, "tool", "a", True, 0, 0)]
    got = [(r.conv_id, r.place, r.role, r.text, r.edit) for r in turn_repair.repair(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "place").collect()]
    assert got == [(1, 0, "user", "Hi.", "R"), (1, 1, "assistant", "Yes.", "K")]
    empty = spark.createDataFrame([], SCHEMA)
    assert turn_repair.digest(empty).count() == 0 and turn_repair.repair(empty).count() == 0


def _trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v, key=lambda x: (*x[:3], hashlib.md5(f"{len(x[2].encode())}:{x[2]}{x[3]}".encode()).digest()))] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        donor = c - (c % 5 if c >= 0 else -(-c % 5))
        built[c] = tuple(own.get(donor, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    out = []
    for node, ids in members.items():
        below = [x for x in members if x[:len(node)] == node]
        ends = ",".join(map(str, sorted(c for c in ids if len(built[c]) == len(node))))
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        leaves = sum(not any(len(y) == len(x) + 1 and y[:-1] == x for y in members) for x in below)
        children = sum(len(x) == len(node) + 1 for x in below)
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,per_shard", [(1, 10 ** 6), (2, 7), (3, 40)])
def test_trie_equals_prefix_sets(spark, seed, per_shard):
    r = random.Random(seed)
    rows = [(c, None if r.random() < 0.02 else t, r.choice(["user", "assistant", None]) if t else "user", r.choice(["a", "bé", "", None])) for c in range(-7, 75) for t in range(r.randint(1, 11))]
    rows += [(c, t, "user", "same") for c in range(200, 240) for t in range(12)]  # copies
    rows += [rows[3], rows[3], (None, 1, "user", "x"), (10 ** 15, None, None, None)]
    df = spark.createDataFrame([(*x, False, 3, 4) for x in rows], SCHEMA).repartition(4)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = sorted((tuple(x) for x in prefix_trie.digest(df, per_shard).select(*names).collect()), key=repr)
    assert got == _trie(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.digest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie.digest(spark.createDataFrame([(None, 1, "user", "x", True, 1, 1)], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_find_close_and_leaves(seed):
    r = random.Random(seed)
    opens, depth = [True], 1
    while depth:
        step = len(opens) < 3000 and r.random() < 0.55 or len(opens) < 5
        opens.append(step)
        depth += 1 if step else -1
    tree, at, stack, close = prefix_trie.Parentheses(np.array(opens)), [], [], {}
    for i, o in enumerate(opens):
        if o:
            stack.append(i)
            at.append(i)
        else:
            close[stack.pop()] = i
    at = np.array(at)
    got = tree.find_close(at)
    assert got.tolist() == [close[i] for i in at]
    leaf = [sum(opens[k] and not opens[k + 1] for k in range(a, close[a])) for a in at]
    assert tree.leaves(at, got).tolist() == leaf
