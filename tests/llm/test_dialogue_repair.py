"""Conversation repair against a search over all edit strings and against a quadratic table."""

import hashlib
import itertools
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tickloom.llm import dialogue_repair as dr

PATTERN = re.compile(r"(s?(ua)+)?")


def brute(kinds: str) -> tuple[int, str]:
    """Smallest (cost, audit) by going through the rows with every edit, places of the pattern as states."""
    step = {("B", "s"): "S", ("B", "u"): "U", ("S", "u"): "U", ("A", "u"): "U", ("U", "a"): "A"}

    def closed(best):
        while True:
            more = dict(best)
            for p, (c, a) in best.items():
                for r in "ua":
                    q = step.get((p, r))
                    if q and (q not in more or (c + 5, a + "I") < more[q]):
                        more[q] = (c + 5, a + "I")
            if more == best:
                return best
            best = more

    best = closed({"B": (0, "")})
    for k in kinds:
        new = {}
        for p, (c, a) in best.items():
            options = [(p, 2, "D")]
            if k != "d":
                extra = 5 * k.isupper()
                options += [(step.get((p, k.lower())), extra, "K")] + [(step.get((p, r)), 1 + extra, "R") for r in "ua"]
            for q, cost, letter in options:
                if q and (q not in new or (c + cost, a + letter) < new[q]):
                    new[q] = (c + cost, a + letter)
        best = closed(new)
    return min(best[q] for q in "BA" if q in best)


def exhaustive(kinds: str) -> tuple[int, str]:
    """Over all edit strings with at most three insertions."""
    found = []
    gaps = len(kinds) + 1
    for edits in itertools.product("KRD", repeat=len(kinds)):
        cost, options = 0, []
        for k, e in zip(kinds, edits):
            if e != "D" and k == "d" or e == "K" and k.lower() == "x":
                break
            cost += {"K": 0, "R": 1, "D": 2}[e] + 5 * (e != "D" and k.isupper())
            options.append([k.lower()] if e == "K" else ["u", "a"] if e == "R" else [""])
        else:
            for places in itertools.product(range(3), repeat=gaps):
                if sum(places) > 3:
                    continue
                audit = "".join("I" * n + e for n, e in zip(places, [*edits, ""]))
                roles = [x for n, o in zip(places, [*options, [""]]) for x in [*[["u", "a"]] * n, o]]
                if any(PATTERN.fullmatch("".join(r)) for r in itertools.product(*roles)):
                    found.append((cost + 5 * sum(places), audit))
    return min(found)


def test_cells_against_all_edit_strings():
    for n in range(4):
        for kinds in itertools.product("dsuaUx", repeat=n):
            assert dr.cheapest(dr.parse("".join(kinds))) == exhaustive("".join(kinds)) == brute("".join(kinds))


def test_longer_runs_and_any_split():
    x = 7
    for n in (9, 17, 40, 133):
        for _ in range(20):
            kinds = ""
            for _ in range(n):
                x = (x * 1103515245 + 12345) % 2**31
                kinds += "uauasxdUAS"[x >> 16 & 7 if x & 3 else 8]
            whole = dr.parse(kinds)
            assert dr.cheapest(whole) == brute(kinds)
            cut = 1 + x % (n - 1)
            assert dr.combine(dr.parse(kinds[:cut]), dr.parse(kinds[cut:])) == whole


def by_hand(rows):
    """Damage, faults, repair of whole conversations in plain Python."""
    say = lambda v: " " if v is None else str(v)
    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        code, role, text = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20, say(role), say(text)
        if code == 0:
            continue
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        own += [(turn, role, text)] * (2 if code == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, kinds, faults = set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in own:
            last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None
            seen.add((role, text))
            initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
            if fault:
                faults[fault] += 1
            kinds += initial if fault is None else initial.upper() if fault == "truncated" else "d"
        turns = [t for t, _, _ in own if t is not None]
        initials = [r[:1] for _, r, _ in own]
        cost, audit = brute(kinds)
        pieces, at, odd = [], 0, sum(map(audit.count, "KRI")) % 2
        for letter in audit:
            role, text = (None, "") if letter == "I" else own[at][1:]
            at += letter != "I"
            if letter != "D":
                pieces.append(f"{role if letter == 'K' else ('user', 'assistant')[(len(pieces) - odd) % 2]}:{text}")
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *faults.values(),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(pieces).encode()).hexdigest(), pieces)
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.fixture(scope="module")
def rows():
    out = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes?"), (1, 1, "assistant", "Yes?"), (1, 4, "tool", "x!"), (1, None, None, None),
           (2, 0, "system", "Be kind."), (2, 1, "user", None), (None, 3, "user", "Null id."), (None, None, "assistant", " \t\n"), (3, 5, "", ""),
           (4, None, "user", "a."), (4, None, "assistant", "b."), (5, 0, "user", "é" * 100_000 + "."), (5, 1, "assistant", "kurz")]
    out += [(10 + c, t, ("system" if t == 0 and c % 5 == 0 else ("user", "assistant")[t % 2]), f"text {c} {t % 3}" + ".!?, "[(c + t) % 5])
            for c in range(60) for t in range(c % 9)]
    # One conversation with a third of all rows, texts that recur far apart, and one turn held by many equal rows.
    out += [(7, t // 2, ("user", "assistant")[t % 2], f"long {t % 101}.") for t in range(400)] + [(8, 2, "user", "same.")] * 150
    return out


def test_query_against_plain_python(spark, rows):
    schema = "conv_id long, turn long, role string, text string, part int, kind string, cost double"
    table = spark.createDataFrame([(*r, 1, "k", 0.5) for r in rows], schema).repartition(5)
    want = by_hand(rows)
    damaged, ids = dr.damaged(table)
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in dr.verdicts(damaged, ids).collect()}
    assert got == {k: v[:8] for k, v in want.items()}
    spark.conf.set("spark.sql.shuffle.partitions", "40")  # runs of one conversation over many tasks, merged in two rounds
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        again = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in dr.verdicts(damaged, ids).collect()}
        assert again == got
        fixed = {}
        for r in dr.repaired(damaged).orderBy("conv_id", "place").collect():
            fixed.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert fixed == {k: v[8] for k, v in want.items() if v[8]}


def test_query_on_the_given_table(spark):
    from tickloom.llm import queries
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op12_dialogue_repair(spark, sf).collect()}
    assert got == {k: v[:8] for k, v in by_hand(rows).items()}


def test_empty_table(spark):
    table = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert dr.verdicts(*dr.damaged(table)).collect() == [] and dr.repaired(table).collect() == []


def test_ids_without_rows(spark):
    table = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    ids = spark.range(1).select(F.lit(5).cast("long").alias("conv_id"))
    (row,) = dr.verdicts(table, ids).collect()
    assert tuple(row) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
