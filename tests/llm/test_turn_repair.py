import hashlib
import heapq
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from cohortveil.llm import queries as Q
from cohortveil.llm import turn_repair as R

SEEN = re.compile(r"[^\x20\x09-\x0D]")
TURNS = "conv_id long, turn long, role string, text string"


def fault_of(rows):
    """Fault of each (turn, role, text) in order."""
    out, seen = [], set()
    for _, role, text in rows:
        marks = SEEN.findall(text)
        out.append("blank" if not marks else "duplicate" if (role, text) in seen else
                   "truncated" if marks[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def search(initials, faults):
    """(cost, audit, roles): cheapest first, then least audit, over a graph of (turns read, state)."""
    n = len(initials)
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n and state in (0, 2):
            return cost, audit, list(out)
        want = "a" if state == 3 else "u"
        after = 2 if want == "a" else 3
        heapq.heappush(heap, (cost + 2, audit + "I", i, after, (*out, (None, want))))
        if i < n:
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if faults[i] not in ("blank", "duplicate"):
                late = faults[i] == "truncated"
                if initials[i] == want:
                    heapq.heappush(heap, (cost + late, audit + "K", i + 1, after, (*out, (i, ""))))
                if initials[i] == "s" and state == 0:
                    heapq.heappush(heap, (cost + late, audit + "K", i + 1, 1, (*out, (i, ""))))
                heapq.heappush(heap, (cost + late + 2, audit + "R", i + 1, after, (*out, (i, want))))


def brute(rows):
    """Digest columns of one conversation's (turn, role, text) rows in order."""
    faults = fault_of(rows)
    cost, audit, out = search([r[1][:1] for r in rows], faults)
    lines = [f"{R.ROLES[w] if i is None or w else rows[i][1]}:{'' if i is None else rows[i][2]}" for i, w in out]
    numbers = [r[0] for r in rows if r[0] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        out += [(conv, turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    return out


def expected(rows, convs=None):
    held = {c: [] for c in convs or ()}
    for r in rows:
        held.setdefault(r[0], []).append(r[1:])
    out = {}
    for conv, own in held.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        out[conv] = brute(own)
    return out


def got(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r.conv_id: tuple(r[n] for n in names) for r in df.collect()}


def repaired(turns):
    summaries, pieces = R.repair(turns)
    return got(summaries.withColumnRenamed("conv_id", "s").join(
        R.digests(pieces), Q.F.col("s").eqNullSafe(Q.F.col("conv_id"))).drop("s"))


rows_of_turns = st.lists(st.tuples(st.sampled_from("sua x"), st.sampled_from([None, None, "blank", "duplicate", "truncated"])), max_size=9)


def cut_up(rows, sizes):
    """Blocks of the given sizes in turn, chained."""
    blocks, at, k = [], 0, 0
    while at < len(rows):
        part = rows[at:at + sizes[k % len(sizes)]]
        blocks.append(R._align([(None, i.strip(), "", f) for i, f in part], range(4)))
        at += len(part)
        k += 1
    cost, taken = R.chain(blocks)
    return cost, "".join(b[w][3] for b, (_, w) in zip(blocks, taken)) + R.ENDINGS[taken[-1][0]]


@settings(max_examples=600, deadline=None)
@given(rows_of_turns, st.lists(st.integers(1, 4), min_size=1, max_size=3))
def test_one_block_and_many_equal_search(rows, sizes):
    want = search([i.strip() for i, _ in rows], [f for _, f in rows])[:2]
    assert cut_up(rows, [100]) == want
    assert cut_up(rows, sizes) == want


def test_long_conversations_equal_search():
    rng = random.Random(4)
    for n in (60, 200):
        rows = [(rng.choice("uuaas"), rng.choice([None, None, None, "blank", "truncated"])) for _ in range(n)]
        want = search([i for i, _ in rows], [f for _, f in rows])[:2]
        assert cut_up(rows, [n]) == want and cut_up(rows, [17]) == want


def random_turns(rng, convs, longest):
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(longest)):
            rows.append((c, rng.choice([t, t, t, t, None, t * 2]), rng.choice(["user", "assistant", "user", "assistant", "system", None, "tool", ""]),
                         rng.choice(["Yes.", "No!", "why", "Well then?", "", " \n", None, f"Number {t}.", f"{t} ends here. \t"])))
    return rows


def test_blocks_partitions_and_hot_conversations(spark, monkeypatch):
    rng = random.Random(7)
    rows = random_turns(rng, 60, 9) + [(999, t, rng.choice(["user", "assistant"]), rng.choice(["Yes.", f"{t}.", "", f"{t}"])) for t in range(400)]
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Hi.")]
    full = [tuple(" " if k > 1 and v is None else v for k, v in enumerate(r)) for r in rows]
    want = expected(full)
    turns = spark.createDataFrame(rows, TURNS).repartition(3)
    assert repaired(turns) == want
    real = R._blocks

    def small(batches):
        R.BLOCK = 7  # on the worker as well
        try:
            yield from real(batches)
        finally:
            R.BLOCK = 512

    monkeypatch.setattr(R, "_blocks", small)
    assert repaired(turns) == want


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = expected(damage(rows), {r[0] for r in rows})
    assert got(Q.QUERIES["op12_turn_repair"](spark, sf)) == want
    assert sum(w[5] > 0 for w in want.values()) > 10


def test_nulls_ties_extra_columns_and_none(spark, tmp_path):
    rng = random.Random(11)
    rows = random_turns(rng, 80, 6) + [(None, 0, "user", "A."), (None, 1, None, None), (500, 3, "user", "Same."), (500, 3, "user", "Same.")]
    turns = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], TURNS + ", conv string, block int, mark string")
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    assert got(Q.QUERIES["op12_turn_repair"](spark, str(tmp_path))) == expected(damage(rows), {r[0] for r in rows})
    none = spark.createDataFrame([], TURNS)
    assert repaired(none) == {}
    none.write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert got(Q.QUERIES["op12_turn_repair"](spark, f"{tmp_path}/none")) == {}


def test_very_long_turns_close_a_block(spark, monkeypatch):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"{t} " + "word " * 20_000 + ".") for t in range(6)]
    real = R._blocks

    def small(batches):
        R.BLOCK_CHARS = 150_000
        try:
            yield from real(batches)
        finally:
            R.BLOCK_CHARS = 8_000_000

    monkeypatch.setattr(R, "_blocks", small)
    assert repaired(spark.createDataFrame(rows, TURNS)) == expected(rows)
