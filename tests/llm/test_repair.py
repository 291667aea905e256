import hashlib
import random
import re
import zlib
from itertools import product

from lithoscope.llm import queries, repair
from lithoscope.llm.common import table

BLANK = re.compile(r"[^\x20\x09-\x0D]")


def brute(symbols):
    """Cost and letters of the cheapest repair, by trying every one: least (cost, letters) by place and state, one row at a time."""
    def inserted(best):
        for _ in range(6):
            for s, (cost, letters) in list(best.items()):
                d = {"": "u", "s": "u", "u": "a", "a": "u"}[s]
                best[d] = min(best.get(d, (10**9, "")), (cost + 5, letters + "I"))
        return best

    best = {"": (0, "")}
    for initial, fault in symbols:
        new = {}
        for s, (cost, letters) in inserted(best).items():
            options = [(s, 2, "D")]
            if fault != "gone":
                more = 5 if fault == "cut" else 0
                due = {"": "su", "s": "u", "u": "a", "a": "u"}[s]
                if initial and initial in due:
                    options.append((initial, more, "K"))
                options.append((due[-1], 1 + more, "R"))
            for to, add, letter in options:
                new[to] = min(new.get(to, (10**9, "")), (cost + add, letters + letter))
        best = new
    best = inserted(best)
    return min(best[s] for s in ("", "a") if s in best)


def expected(rows):
    """One conversation's contract columns from its damaged rows (turn, role, text), by plain loops."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        last = BLANK.findall(text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    cost, letters = brute([(r[1][:1], {"blank": "gone", "duplicate": "gone", "truncated": "cut", "": ""}[f]) for r, f in zip(rows, faults)])
    out, left = [], list(rows)
    for letter in letters:
        row = left.pop(0) if letter != "I" else None
        initials = [x[0] for x in out]
        due = "assistant" if initials and initials[-1][:1] == "u" else "user"
        if letter != "D":
            out.append((row[1] if letter == "K" else due, row[2] if row else ""))
    assert re.fullmatch("(s?(ua)+)?", "".join(role[:1] for role, _ in out)) and not left
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, letters, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest())


def damaged(rows):
    """Damaged rows by conversation, of rows (conv_id, turn, role, text)."""
    found = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        own = found.setdefault(conv, [])
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        own += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return found


def asked(spark, where):
    return {r[0]: tuple(r)[1:] for r in queries.op13_repair(spark, where).collect()}


def test_query_is_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert asked(spark, sf) == {c: expected(own) for c, own in damaged(rows).items()}


def test_edges(spark, tmp_path):
    rng = random.Random(3)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "User", " u"], ["Yes.", "no", "", None, "\n\t ", "Why?  \n", "a.b", "é!", "日本。", "x" * 9]
    rows = [(rng.choice([None, 1, 2, 3, -5, 10**12]), rng.choice([None, *range(40), -3]), rng.choice(roles), rng.choice(texts)) for _ in range(400)]
    rows += [(7, k, ("user", "assistant")[k % 2], f"Turn {k}.") for k in range(300)] + [(8, k, "user", f"Again {k}" + "." * (k % 2)) for k in range(700)]
    rows += [(9, None, "user", "Same.")] * 30 + [(c, 0, "system", "Alone.") for c in range(100, 160)]
    data = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, `known a.b` int")
    data.write.parquet(f"{tmp_path}/conversations.parquet")
    want = {c: expected(own) for c, own in damaged(rows).items()}
    assert asked(spark, str(tmp_path)) == want and any(w[6] == "" and w[0] == 0 for w in want.values())
    data.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert asked(spark, f"{tmp_path}/none") == {}


def test_every_short_conversation():
    symbols = [*product("sua", ("", "cut")), ("", "gone"), ("t", "")]
    for n in range(4):
        for row in product(symbols, repeat=n):
            assert repair.cheapest(list(row)) == brute(row), row
    rng = random.Random(1)
    for _ in range(300):  # with long runs
        row = [s for _ in range(rng.randint(1, 6)) for s in [rng.choice(symbols)] * rng.choice([1, 2, 3, 7, 40])]
        assert repair.cheapest(row) == brute(row), row


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "Still here?"), (1, 5, "assistant", "Yes.")]
    got = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [(r.n_rows, r.gaps, r.duplicate, r.illegal, r.cost, r.audit) for r in got] == [(4, 2, 1, 2, 4, "DDKK")]
    assert [tuple(t) for t in got[0].turns] == [("user", "Still here?"), ("assistant", "Yes.")]
