import random
import re
import zlib
from itertools import product

from tesselune.llm.turns import damaged, faults, parse, repair_conversations, repaired

PATTERN = re.compile("(s?(ua)+)?")


def brute(rows):
    """The least (cost, audit) over all edits, with up to two rows inserted at each place."""
    best = None
    for edits in product("KRD", repeat=len(rows)):
        if any(f in (1, 2) and e != "D" for e, (_, f) in zip(edits, rows)):
            continue
        base = sum({"K": 0, "R": 3, "D": 4}[e] + 3 * (f == 3 and e != "D") for e, (_, f) in zip(edits, rows))
        for inserts in product(range(3), repeat=len(rows) + 1):
            cost = base + 3 * sum(inserts)
            if best and cost > best[0]:
                continue
            audit, slots = "", []
            for k, n in enumerate(inserts):
                slots += ["ua"] * n
                audit += "I" * n
                if k < len(rows):
                    audit += edits[k]
                    slots += {"K": [rows[k][0]], "R": ["ua"], "D": []}[edits[k]]
            if (best is None or (cost, audit) < best) and any(PATTERN.fullmatch("".join(x)) for x in product(*slots)):
                best = cost, audit
    return best


def test_parser_equals_brute_force():
    rng = random.Random(2)
    for n in (0, 1, 2, 3):
        for _ in range(60 if n else 1):
            rows = tuple((rng.choice("ssuuaax"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(n))
            assert parse(rows) == brute(rows), rows
    for _ in range(12):
        rows = tuple((rng.choice("sua"), rng.choice([0, 0, 3])) for _ in range(4))
        assert parse(rows) == brute(rows), rows


def test_another_grammar():
    nested = (("start", ("u", "start", "a")), ("start", ()), ("start", ("start", "start")))
    assert parse((("u", 0), ("u", 0), ("a", 0), ("a", 0)), nested) == (0, "KKKK")
    assert parse((("u", 0), ("u", 0), ("a", 0)), nested) == (3, "KIKK")
    assert parse((("a", 0), ("u", 0)), nested) == (6, "IKKI")


def by_hand(rows):
    """What the operator should give for the rows of one conversation, (turn, role, text), in order."""
    roles, texts = [r for _, r, _ in rows], [t for *_, t in rows]
    found = faults(roles, texts)
    cost, audit = brute(tuple((r[:1], f) for r, f in zip(roles, found)))
    turns = [t for t, *_ in rows if t is not None]
    pairs = sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, found.count(1), found.count(2), found.count(3), pairs, cost, audit, repaired(roles, texts, audit))


def test_conversations(spark):
    talks = {
        1: [(0, "system", "Rules."), (1, "user", "Hi!"), (2, "assistant", "Hello.")],
        2: [(0, "user", "Hi!"), (0, "user", "Hi!"), (5, "assistant", " \x85")],
        3: [(None, " ", "ok."), (1, "assistant", "cut")],
        4: [(2, "User", "x."), (3, "tool", "y."), (4, "", "z.")],
        None: [(7, "assistant", "a?"), (9, "user", " ")],
    }
    rows = [(c, t, r, x, "k", 3) for c, talk in talks.items() for t, r, x in talk]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string, there int").repartition(3)
    got = {r.conv_id: (*tuple(r)[1:8], [tuple(x) for x in r.repaired]) for r in repair_conversations(docs).collect()}
    assert got == {c: by_hand(t) for c, t in talks.items()}
    assert got[2][:7] == (4, 0, 1, 1, 1, 7, "KDK") and got[1][5:] == (0, "KKK", [tuple(x[1:]) for x in talks[1]])
    assert repair_conversations(docs.limit(0)).count() == 0


def test_nulls_and_conversations_without_rows(spark):
    rows = [(1, 0, None, None, True), (1, 1, "user", None, True), (2, 0, "user", "x.", False)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, there boolean")
    got = {r.conv_id: tuple(r)[1:] for r in repair_conversations(docs, there_col="there").collect()}
    assert got == {1: (0, 2, 0, 0, 1, 8, "DD", []), 2: (0, 0, 0, 0, 0, 0, "", [])}


def test_a_very_long_conversation(spark):
    rng = random.Random(5)
    rows = [(7, k, rng.choice(["user", "assistant", "system"]), f"text {k}.") for k in range(4000)]
    r = repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    initials = "".join(x.role[0] for x in r.repaired)
    assert PATTERN.fullmatch(initials) and sum(c != "I" for c in r.audit) == 4000
    assert r.cost == 3 * (r.audit.count("R") + r.audit.count("I")) + 4 * r.audit.count("D")


def test_damage_by_rule(spark):
    rows = [(c, t, "assistant", "Yes. No!") for c in range(30) for t in range(5)] + [(None, 1, None, "a.b"), (5, None, "user", None)]
    got = sorted((str(r.conv_id), str(r.turn), r.role, r.text, r.there) for r in damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    want = []
    for c, t, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        k, role, text = zlib.crc32(key.encode()) % 20, role or " ", " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        want += [(str(c), str(t), "user" if k == 4 else role, text, k != 0)] * (2 if k == 3 else 1)
    assert got == sorted(want)
