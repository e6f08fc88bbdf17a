"""Conversation repair against a brute force over whole audits."""

import hashlib
import itertools
import random
import re
import zlib

from ioloom.llm import turn_repair
from ioloom.llm.queries import op13_turn_repair

WORD = re.compile(r"[^\x20\x09-\x0D]")


def rows_after_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if what == 0:
            continue
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        out += [(turn, "user" if what == 4 else role, text)] * (2 if what == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        marks = WORD.findall(text)
        out.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """All audits, cheapest first: every edit of every row, up to two inserts at every place."""
    best = None

    def go(i, roles, audit, cost, said, inserts):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if not re.fullmatch("(s|s?u|s?(ua)+u?)?", roles):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best or (cost, audit, said), (cost, audit, said))
        if inserts < 2:
            for r in ("user", "assistant"):
                go(i, roles + r[0], audit + "I", cost + 3, [*said, (r, "")], inserts + 1)
        if i == len(rows):
            return
        _, role, text = rows[i]
        go(i + 1, roles, audit + "D", cost + 4, said, 0)
        if faults[i] in ("blank", "duplicate"):
            return
        more = 3 * (faults[i] == "truncated")
        go(i + 1, roles + (role[:1] or "?"), audit + "K", cost + more, [*said, (role, text)], 0)
        for r in ("user", "assistant"):
            go(i + 1, roles + r[0], audit + "R", cost + 3 + more, [*said, (r, text)], 0)

    go(0, "", "", 0, [], 0)
    return best


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = rows_after_damage([r for r in rows if r[0] == conv])
        faults = faults_of(mine)
        turns = [t for t, _, _ in mine if t is not None]
        cost, audit, said = cheapest(mine, faults)
        initials = [r[:1] for _, r, _ in mine]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest(),
        )
    return out


def answered(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_repair_equals_brute_force(spark):
    rng = random.Random(3)
    texts = ["Yes.", "No", "", " \t", "What?", "ok! ", None, "long " * 20_000 + "end.", "nul\0 in it.", "\x85"]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "s"]
    rows = [(c if c else None, rng.choice([None, *range(8)]) if c % 3 else t, rng.choice(roles), rng.choice(texts)) for c in range(120) for t in range(rng.randint(1, 5))]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({c: turn_repair.F.lit(c) for c in ("k", "known", "nth", "fault", "a.b", "c`d")})
    got = answered(turn_repair.repair(turn_repair.damage(turns)))
    assert got == expected(rows)


def test_conversations_across_batches_and_without_rows(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rng = random.Random(5)
    rows = [(1, t, ["user", "assistant"][t % 2], f"Turn {t}{rng.choice(['.', '', '?'])}") for t in range(3000)] + [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", "B", ""])) for c in range(2, 30) for t in range(4)]
    gone = [c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    rows += [(c, 0, "user", "Hello.") for c in gone]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    try:
        got = answered(op13_turn_repair(spark, str(tmp_path)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    nothing = hashlib.sha256(b"").hexdigest()
    assert gone and all(got[c] == (0, 0, 0, 0, 0, 0, "", nothing) for c in gone)
    short = [r for r in rows if r[0] != 1]
    assert {c: x for c, x in got.items() if c != 1} == expected(short)
    after = rows_after_damage([r for r in rows if r[0] == 1])
    assert len(got[1][6].replace("I", "")) == len(after) and got[1][5] < 4 * len(after)


def test_an_empty_table_gives_no_rows(spark):
    turns = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert turn_repair.repair(turn_repair.damage(turns)).collect() == []
