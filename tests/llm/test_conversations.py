"""The trie of conversation beginnings and the repair of conversations against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from dayweave.llm import prefix_trie, structure_repair
from dayweave.llm.prefix_trie import Peeler

SCHEMA = "conv_id long, turn long, role string, text string, conv long, pos int, mark string, words int, path binary, depth long, cost long, block int, copy int"


def frame(spark, rows):
    rows = [(*r, 1, 2, "x", 3, b"", 4, 5, 6, 7) for r in rows]
    random.Random(5).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def mark(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def ordered(rows):
    """Turns of each conversation in order, nulls empty."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, mark(role or "", text or ""), (role or "", text or "")))
    return {c: [t[3] for t in sorted(v)] for c, v in convs.items()}


def plain_trie(convs):
    """Rows by brute force over all beginnings."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    own = {n: (len(m) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0) for n, m in members.items()}
    inner = {n[:-1] for n in members if n}
    out = []
    for n, m in members.items():
        below = [x for x in members if x[: len(n)] == n]
        ends = sorted(c for c in m if len(convs[c]) == len(n))
        out.append(
            (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), sum(len(x) == len(n) + 1 for x in below), sum(x not in inner for x in below), sum(own[x] for x in below), sha(",".join(map(str, ends))))
        )
    return sorted(out, key=str)


def family(convs):
    """Every conversation with the first turns of c - c % 20 before its own rest."""
    out = {}
    for c, own in convs.items():
        h, first = zlib.crc32(str(c).encode()) % 4, int(c / 20) * 20
        out[c] = convs.get(first, [])[:h] + own[h:]
    return out


def random_rows(n, seed, texts=3, longest=6):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a b", "c", "d  e\tf", "é x ?"][:texts])))
    return rows


TRIE_EDGE = [
    (0, None, "user", "z"), (0, 0, None, "a b"), (0, 1, "user", None), (1, 0, "", "a b"), (1, 1, "user", ""), (2, 5, "u", "x"), (2, 5, "u", "x"), (2, 5, "t", "x"), (3, None, None, None),
    (25, 1, "user", "lost"), (-7, 1, "user", "below"), (-20, 0, "user", "head"), (None, 0, "user", "none"), (None, None, None, None), (40, 0, "user", "one"), (41, 0, "user", "one"), (43, 0, "a", "b"),
]


def trie_rows(df):
    return sorted((tuple(r) for r in df.select(*prefix_trie.COLUMNS).collect()), key=str)


@pytest.mark.parametrize("waiting", [prefix_trie.WAITING, 0])
def test_trie(spark, waiting):
    for rows in (TRIE_EDGE, random_rows(120, 1), [(c, t, "user", "same") for c in range(40) for t in range(3)]):
        df, convs = frame(spark, rows), ordered(rows)
        assert trie_rows(prefix_trie.shared_prefixes(df, borrow=True)) == plain_trie(family(convs))
        numbered = prefix_trie.turns(df).selectExpr("*", "0 AS part")
        assert trie_rows(prefix_trie.trie(prefix_trie.paths(numbered), waiting=waiting)) == plain_trie(convs)


def test_trie_over_many_ranges(spark):
    """Stretches of a few conversations each, so that most nodes are border nodes somewhere."""
    rows = random_rows(300, 2, texts=2, longest=5)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert trie_rows(prefix_trie.shared_prefixes(frame(spark, rows))) == plain_trie(ordered(rows))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_trie_long_and_empty(spark):
    rows = [(c, t, "user", f"turn {t if c < 2 or t < 900 else -c - t}") for c in range(3) for t in range(1000 + c)] + [(9, 0, "user", "w " * 200_000)]
    got = trie_rows(prefix_trie.shared_prefixes(frame(spark, rows)))
    convs = ordered(rows)
    assert len(got) == 1 + 1001 + 102 + 1
    deepest = {r[1]: r for r in got if r[0] == 0}
    assert deepest[900][3] == 3 and deepest[900][5] == 2 and deepest[900][6] == 2 * 2 + 100 * 2
    assert deepest[1000][7] == sha("0") and convs
    assert prefix_trie.shared_prefixes(frame(spark, rows).limit(0), borrow=True).count() == 0


def test_peeler_alone():
    """A single stretch: only the first and the last path stay open."""
    peeler = Peeler(0)
    for conv, path in enumerate(sorted(["", "a", "ab", "ab", "abc", "b", "bc"])):
        peeler.add(conv, b"".join(x.encode() * 16 for x in path), [1] * len(path))
    peeler.finish()
    closed = sorted((r[5], r[4], r[6], r[7], r[8], r[9], r[10]) for r in peeler.done if r[0])
    assert closed == [(1, 1, None, 4, 1, 1, 3 + 2), (2, 2, 1, 3, 1, 1, 2), (3, 4, 2, 1, 0, 1, 0)]
    assert [(r[5], r[7]) for r in peeler.done if not r[0]] == [(2, 1), (1, 2), (0, 7)]


BLANK = re.compile(r"[\x20\x09-\x0D]*")
GOOD = re.compile("(s?(ua)+)?")


def plain_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out[conv] += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
    return out


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        left = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not left else "duplicate" if (role, text) in seen else "" if left[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain_repair(turns):
    """Cheapest, then ASCII-least edits by trying all of them, with the repaired turns."""
    bad = faults(turns)
    best = None
    most = 3 * len(turns)

    def go(i, cost, audit, roles, lines):
        nonlocal best
        if cost > (best[0] if best else most) or len(roles) > 2 * len(turns) + 2:
            return
        if i == len(turns) and GOOD.fullmatch(roles):
            best = min(best or (cost, audit, lines), (cost, audit, lines))
        for role in ("user", "assistant"):
            if fits(roles + role[0]):
                go(i, cost + 2, audit + "I", roles + role[0], [*lines, f"{role}:"])
        if i < len(turns):
            _, role, text = turns[i]
            go(i + 1, cost + 3, audit + "D", roles, lines)
            if bad[i] in ("", "truncated"):
                more = bad[i] == "truncated"
                if role and fits(roles + role[0]):
                    go(i + 1, cost + more, audit + "K", roles + role[0], [*lines, f"{role}:{text}"])
                for other in ("user", "assistant"):
                    if fits(roles + other[0]):
                        go(i + 1, cost + 2 + more, audit + "R", roles + other[0], [*lines, f"{other}:{text}"])

    def fits(roles):
        return re.fullmatch("s?(ua)*u?", roles)

    go(0, 0, "", "", [])
    return best


def plain_row(conv, turns):
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
    bad, numbers = faults(turns), [t[0] for t in turns if t[0] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    cost, audit, lines = plain_repair(turns)
    return (conv, gaps, bad.count("blank"), bad.count("duplicate"), bad.count("truncated"), illegal, cost, audit, sha("\n".join(lines)))


REPAIR_EDGE = [
    (0, None, None, None), (0, 3, "user", "a."), (0, 3, "user", "a."), (1, 9, "", "x"), (1, 2, "tool", "y?"), (2, None, "user", "q!"), (2, None, "assistant", "r. \n"), (None, 1, "user", "n."),
    (None, None, "assistant", "m."), (3, 1, "system", "s."), (3, 5, "user", "\t\r "), (3, 6, "Assistant", "w."), (4, 1, "assistant", "é漢😀."), (126, 1, "user", "goes."), (163, 1, "user", None),
]


def repair_rows(df):
    return sorted((tuple(r) for r in structure_repair.repair(df).collect()), key=str)


def test_repair(spark):
    rng = random.Random(3)
    rows = REPAIR_EDGE + [
        (10 + c, t * rng.choice([1, 1, 2]), rng.choice(["user", "assistant", "assistant", "system", "x"]), rng.choice(["a.", "b", "c!", " ", "d?", f"{t}."])) for c in range(60) for t in range(rng.randint(1, 6))
    ]
    damaged = plain_damage(rows)
    assert any(not v for v in damaged.values())
    assert repair_rows(structure_repair.damaged(frame(spark, rows))) == sorted((plain_row(c, v) for c, v in damaged.items()), key=str)
    assert structure_repair.repair(structure_repair.damaged(frame(spark, rows).limit(0))).count() == 0


def test_checkpoints_do_not_matter():
    """A walk block by block gives the edits of one walk over everything."""
    rng = random.Random(4)
    for n in (1, 2, 7, 30, 200):
        symbols = "".join(rng.choice("suaSUAd.:") for _ in range(n))
        costs = [structure_repair.END_COSTS]
        for s in reversed(symbols):
            costs.append(structure_repair.before(s, costs[-1]))
        costs.reverse()
        whole, _ = structure_repair.walk(symbols, structure_repair.END_COSTS, 0, True)
        for size in (1, 3, 15):
            state, edits = 0, []
            for at in range(0, n, size):
                part = symbols[at : at + size]
                more, state = structure_repair.walk(part, costs[min(n, at + size)], state, at + size >= n)
                edits += [(e, i + at if i >= 0 else -1) for e, i in more]
            assert edits == whole


def test_repair_long(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(20_000)] + [(2, 0, "user", "x " * 500_000 + ".")]
    got = {r[0]: r for r in repair_rows(frame(spark, rows).selectExpr("conv_id AS conv", "turn", "role", "text"))}
    assert got[1][1:8] == (0, 0, 0, 0, 0, 0, "K" * 20_000)
    assert got[1][8] == sha("\n".join(f"{r}:{t}" for _, _, r, t in rows[:-1]))
    assert got[2][6:8] == (2, "KI")
