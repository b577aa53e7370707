import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from bazaarflow.llm import turns
from bazaarflow.llm.turns_query import op12_target_alignment

GRAMMAR = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, _md5 string, n string, audit string"


def brute(rows):
    """(cost, audit, repaired) of the cheapest edits, by all edits of up to two inserts in a gap."""
    best = None
    choices = []
    for role, _, fault in rows:
        stay = [("K", 0, role), ("R", 2, "user"), ("R", 2, "assistant")] if fault not in ("blank", "duplicate") else []
        choices.append([("D", 3, None), *[(e, c + (fault == "truncated"), r) for e, c, r in stay]])
    inserts = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
    for gaps in itertools.product(inserts, repeat=len(rows) + 1):
        for edits in itertools.product(*choices):
            cost, audit, out = 0, "", []
            for k, gap in enumerate(gaps):
                cost += 2 * len(gap)
                audit += "I" * len(gap)
                out += [(r, "") for r in gap]
                if k < len(rows):
                    e, c, role = edits[k]
                    cost, audit = cost + c, audit + e
                    if role is not None:
                        out.append((role, rows[k][1]))
            if (best is None or (cost, audit) < best[:2]) and GRAMMAR.fullmatch("".join(r[:1] or "?" for r, _ in out)):
                best = (cost, audit, out)
    return best


def cheapest(rows):
    """The same by a search of states in the order of cost, for long conversations: cost and audit."""
    heap, seen = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            return cost, audit
        if (i, state) in seen:
            continue
        seen.add((i, state))
        after = 3 if state == 2 else 2
        heapq.heappush(heap, (cost + 2, audit + "I", i, after))
        if i < len(rows):
            role, _, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state))
            if fault not in ("blank", "duplicate"):
                cost += fault == "truncated"
                heapq.heappush(heap, (cost + 2, audit + "R", i + 1, after))
                if role[:1] == "s" and state == 0:
                    heapq.heappush(heap, (cost, audit + "K", i + 1, 1))
                elif role[:1] == ("a" if state == 2 else "u"):
                    heapq.heappush(heap, (cost, audit + "K", i + 1, after))


def faulted(rows):
    """(role, text, fault) of rows in order."""
    seen, out = set(), []
    for role, text in rows:
        visible = re.findall("[^\x20\x09-\x0d]", text)
        fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def letters(rows):
    return "".join(chr(ord("A") + 4 * ("sua".find(r[:1]) if r[:1] in tuple("sua") else 3) + turns.FAULTS.index(f)) for r, _, f in rows)


def damage(table):
    out = {}
    for conv, turn, role, text in table:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out.setdefault(conv, []).extend([(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    return out


def expected(table, solve):
    for conv, rows in damage(table).items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        numbers = [t for t, _, _ in rows if t is not None]
        found = faulted([r[1:] for r in rows])
        initials = [r[:1] or "?" for r, _, _ in found]
        cost, audit, *out = solve(found)
        yield (conv, max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *[sum(f == k for _, _, f in found) for k in turns.FAULTS[1:]],
               sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, *out)


def conversation(r, n):
    roles = ["system", "user", "assistant", "assistant", "user", "tool", "", "Assistant", "s"]
    return [(r.choice(roles), r.choice(["Yes.", "No", "", " \n", "Well!", "a", "b?", "c.\t"])) for _ in range(n)]


def test_edits_are_the_cheapest_and_least():
    r = random.Random(1)
    for _ in range(150):
        rows = faulted(conversation(r, r.randint(0, 3)))
        cost, audit, _ = brute(rows)
        found, traced, state = turns.best(letters(rows))
        assert (found, traced + turns.ENDS[state]) == (cost, audit)
        assert cheapest(rows) == (cost, audit)
    for n in [5, 9, 14, 30, 60, 200]:
        for _ in range(10):
            rows = faulted([(role, f"{text}{k if r.random() < 0.7 else ''}.") for k, (role, text) in enumerate(conversation(r, n))])
            found, traced, state = turns.best(letters(rows))
            assert (found, traced + turns.ENDS[state]) == cheapest(rows)


@pytest.mark.parametrize("size", [1, 3, 17])
def test_runs_add_up(size):
    r = random.Random(size)
    for _ in range(30):
        rows = faulted([(role, f"{text}{k}.") for k, (role, text) in enumerate(conversation(r, r.randint(2, 40)))])
        run = letters(rows)
        parts = [("c", 0, k, run[at : at + size]) for k, at in enumerate(range(0, len(run), size))]
        back = turns._traced(turns._backwards(reversed(list(turns._costs(iter(parts))))))
        (conv, *_, cost, audit), = turns._forwards(reversed(list(back)))
        assert (cost, audit) == cheapest(rows)


def hashed(rows):
    return hashlib.sha256("\n".join(f"{role}:{text}" for role, text in rows).encode()).hexdigest()


def test_query_with_odd_rows(spark, folder):
    r = random.Random(4)
    table = [(conv, turn, *row) for conv in range(40) for turn, row in enumerate(conversation(r, 3))]
    table += [(None, None, None, None), (None, 1, "user", "Hi."), (50, None, "user", "A."), (50, None, "assistant", "B."), (51, 2, "user", None),
              (52, 7, "user", "x" * 100_000 + "."), (52, 9, "assistant", "Z!"), (53, 1, "user", "Same."), (53, 1, "user", "Same.")]
    table += [(100 + k, 0, "user", "Only.") for k in range(40)]  # some lose their only turn
    df = spark.createDataFrame([(*row, "c", "c", "c") for row in table], SCHEMA)
    found = op12_target_alignment(spark, folder(conversations=df)).collect()
    want = {x[0]: (*x[:-1], hashed(x[-1])) for x in expected(table, brute)}
    none = (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())
    assert any(not rows for rows in damage(table).values())
    assert len(found) == len({row[0] for row in table})
    for row in found:
        assert tuple(row) == (want.get(row["conv_id"]) or (row["conv_id"], *none))
    assert op12_target_alignment(spark, folder(conversations=df.limit(0))).count() == 0


def test_one_conversation_in_many_runs(spark, folder, monkeypatch):
    r = random.Random(5)
    roles = ["user", "assistant"]
    table = [(1, k, r.choice(roles) if r.random() < 0.1 else roles[k % 2], r.choice(["Yes.", "No", f"n{k}.", f"m{k}!"])) for k in range(1500)]
    table += [(k, t, roles[t], f"{t}.") for k in range(2, 60) for t in range(2)]
    df = spark.createDataFrame([(*row, "c", "c", "c") for row in table], SCHEMA)
    path = folder(conversations=df)
    want = {x[0]: x for x in expected(table, cheapest)}
    for row in op12_target_alignment(spark, path).collect():
        assert tuple(row)[:-1] == want[row["conv_id"]]
