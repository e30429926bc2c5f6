"""Operator 13 against all edit sequences of short conversations, and on odd rows."""

import hashlib
import itertools
import random
import re
import zlib

from foliospark.llm import conversation_repair as repair_module

GOOD = re.compile(r"(s?(ua)+)?")
ROLES = {"u": "user", "a": "assistant"}


def all_edits(turns):
    """(cost, audit, result) of the best of all sequences of edits of [(role, text, fault)] with at most two insertions in a gap."""
    gaps = ["", "u", "a", "ua", "au", "uu", "aa"]
    options = []
    for role, text, fault in turns:
        extra = 3 if fault == "truncated" else 0
        each = [(4, "D", [])]
        if fault not in ("blank", "duplicate"):
            each += [(extra, "K", [(role, text)])] + [(3 + extra, "R", [(r, text)]) for r in ROLES.values()]
        options.append(each)
    best = None
    for choice in itertools.product(*options):
        for holes in itertools.product(gaps, repeat=len(turns) + 1):
            cost = sum(c for c, _, _ in choice) + 3 * sum(map(len, holes))
            if best and cost > best[0]:
                continue
            audit, out = "I" * len(holes[0]), [(ROLES[x], "") for x in holes[0]]
            for (_, letter, made), hole in zip(choice, holes[1:], strict=True):
                audit += letter + "I" * len(hole)
                out += made + [(ROLES[x], "") for x in hole]
            if GOOD.fullmatch("".join(r[:1] or "?" for r, _ in out)):
                best = min(best, (cost, audit, out)) if best else (cost, audit, out)
    return best


def faults(turns):
    rows = sorted((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for t, r, x in turns)
    seen, out = set(), []
    for _, t, role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


SCHEMA = "conv_id long, turn long, role string, text string, cost string, audit string"


def test_against_all_edits(spark):
    rng = random.Random(4)
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Hi.", "so", "", " \t", "Yes! ", None, "no?\n", "end. "]
    cases = {i: [(rng.choice([None, 1, 2, 3]), rng.choice(roles), rng.choice(texts)) for _ in range(rng.randint(1, 3))] for i in range(60)}
    cases[None] = [(1, "user", "a."), (4, "user", "a.")]
    rows = [(i, t, r, x, "7", "extra") for i, turns in cases.items() for t, r, x in turns]
    got = {r.conv_id: r for r in repair_module.repair(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert set(got) == set(cases)
    for i, turns in cases.items():
        flags = faults(turns)
        cost, audit, out = all_edits(flags)
        numbers = {t for t, _, _ in turns if t is not None}
        pairs = ["".join(x[0][:1] for x in p) for p in itertools.pairwise(flags)]
        r = got[i]
        assert (r.cost, r.audit, [tuple(t) for t in r.repaired]) == (cost, audit, out), (turns, r)
        assert (r.blank, r.duplicate, r.truncated) == tuple(sum(f == n for _, _, f in flags) for n in ("blank", "duplicate", "truncated"))
        assert r.illegal == sum(p not in ("su", "ua", "au") for p in pairs)
        assert r.gaps == (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0)


def test_damage_and_conversations_of_which_nothing_is_left(spark):
    gone = next(t for t in range(10_000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    twice = next(t for t in range(10_000) if zlib.crc32(f"2:{t}".encode()) % 20 == 3)
    rows = [(1, gone, "user", "Hi.", "", ""), (2, twice, None, None, "", ""), (2, twice, "user", "Hi.", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    left = sorted((r.conv_id, r.turn, r.role, r.text) for r in repair_module.damaged(df).collect())
    assert left == [(2, twice, " ", " "), (2, twice, " ", " "), (2, twice, "user", "Hi."), (2, twice, "user", "Hi.")]
    got = {r.conv_id: r for r in repair_module.repair_digests(df, repair_module.damaged(df)).collect()}
    none = hashlib.sha256(b"").hexdigest()
    assert tuple(got[1]) == (1, 0, 0, 0, 0, 0, 0, "", none)
    assert (got[2].audit, got[2].repaired_sha256) == ("DDKDI", hashlib.sha256(b"user:Hi.\nassistant:").hexdigest())
    empty = repair_module.repair_digests(df.limit(0), repair_module.damaged(df.limit(0)))
    assert empty.collect() == [] and "audit" in empty.columns


def test_long_conversations_and_extra_letters(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"{t} \U0001f600{'x' * 2000}.", "", "") for t in range(1, 601)]
    r = repair_module.repair(spark.createDataFrame(rows, SCHEMA)).first()
    assert (r.cost, r.audit, len(r.repaired)) == (0, "K" * 600, 600)


def test_no_python_workers(spark):
    turns = spark.createDataFrame([(1, 1, "user", "Hi.", "", "")], SCHEMA)
    plan = repair_module.repair_digests(turns, repair_module.damaged(turns))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
