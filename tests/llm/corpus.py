"""A small corpus with every awkward case, and plain-Python versions of what the operators compute."""
from __future__ import annotations

import hashlib
import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, marks string, label string, part int, batch int"
EMPTY_ROWS: list = []


def _sentence(r: random.Random, n: int) -> str:
    words = ["".join(r.choice("abcdeilmnorstuv") for _ in range(r.randint(1, 7))) for _ in range(n)]
    return " ".join(words).capitalize() + "."


def rows(seed: int = 3) -> list[tuple]:
    r = random.Random(seed)
    passage = _sentence(r, 70)
    texts: list[str | None] = []
    for _ in range(40):
        texts.append("\n".join(_sentence(r, r.randint(6, 40)) for _ in range(r.randint(2, 9))))
    texts[5] = texts[5] + "\n" + passage + "\n" + texts[5]
    texts[11] = _sentence(r, 30) + " " + passage.lower() + "  " + passage + "\n" + _sentence(r, 30)
    texts[17] = passage + "\t" + _sentence(r, 9)
    texts += [texts[3]] * 4 + [texts[8].upper()]
    for i in (2, 2, 2, 7, 7, 20):  # near copies
        w = texts[i].split(" ")
        for _ in range(2):
            w[r.randrange(len(w))] = "edited" + str(r.randrange(99))
        texts.append(" ".join(w))
    lines = texts[9].split("\n")
    texts.append("\n".join(lines[:-1] + [_sentence(r, 25)]))
    texts.append("\n".join([_sentence(r, 12), "", "  ", *lines]))
    texts += [None, "", " \n\t ", "one", "a b c d", "Heer. " * 130, "ÄÖ naïve ΣΑΣ İx 's don't <|endoftext|> 12    x́ !!?", "x" * 700 + "​", "| a | b | c |\nHome | News | About | Contact | Login\n" + _sentence(r, 60)]
    texts.append(" ".join(_sentence(r, 25) for _ in range(220)) + "\n" + passage)  # long
    r.shuffle(texts)
    out = [(i * 3 if i % 9 else i, t, "en", "s0" if i % 3 == 0 else f"s{i % 5}", len(t or ""), i, "m", "l", 1, 2) for i, t in enumerate(texts)]
    out = list({row[0]: row for row in out}.values())
    out += [out[4], out[4], out[-1]]  # repeated rows
    out += [(None, texts[1], "en", None, 1, 0, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return out


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def repeats(table: list[tuple], window: int = 50) -> list[tuple]:
    """Removal of words covered by windows that start in an earlier document."""
    first: dict = {}
    for row in table:
        if row[0] is not None:
            w = words(row[1])
            for p in range(len(w) - window + 1):
                k = tuple(w[p:p + window])
                first[k] = min(first.get(k, row[0]), row[0])
    out = []
    for row in table:
        w = words(row[1])
        gone = [False] * len(w)
        if row[0] is not None:
            for p in range(len(w) - window + 1):
                if first[tuple(w[p:p + window])] < row[0]:
                    gone[p:p + window] = [True] * window
        out.append((row[0], len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def shingles(text: str | None) -> set:
    w = [x.encode().lower() for x in words(text)]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_groups(table: list[tuple]) -> list[tuple]:
    """doc_id, n_shingles, component, kept per row."""
    ids = [(row[0], shingles(row[1])) for row in table]
    up = {i: i for i, _ in ids if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    named = [(i, s) for i, s in ids if i is not None and s]
    for n, (a, s) in enumerate(named):
        for b, t in named[:n]:
            both = len(s & t)
            if 100 * both >= 75 * (len(s) + len(t) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return [(i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in ids]


def ordered(found) -> list[str]:
    return sorted(map(repr, map(tuple, found)))
