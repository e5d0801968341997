"""Repair of conversations against trying all edits, and of long ones in blocks."""

import hashlib
import random
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from chatterloom.llm import conversation_repair as repair

TYPE = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        yield from [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def legal(initials):
    rest = initials.removeprefix("s")
    return initials == "" or (rest != "" and rest == "ua" * (len(rest) // 2))


def cheapest(rows):
    """All edits of (role, text, fault) up to the best cost, by search over prefixes that can still become legal."""
    import heapq

    heap = [(0, "", 0, ())]
    while heap:
        cost, audit, at, out = heapq.heappop(heap)
        initials = "".join(r[:1] or "-" for r, _ in out)
        if at == len(rows) and legal(initials):
            return cost, audit, out
        if any(legal(initials + x) for x in ("", "a", "ua")):
            last = audit.endswith("II")
            for role in () if last else ("user", "assistant"):
                heapq.heappush(heap, (cost + 3, audit + "I", at, (*out, (role, ""))))
            if at < len(rows):
                role, text, fault = rows[at]
                heapq.heappush(heap, (cost + 4, audit + "D", at + 1, out))
                if fault not in ("b", "d"):
                    more = 3 * (fault == "t")
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, (*out, (role, text))))
                    for new in ("user", "assistant"):
                        heapq.heappush(heap, (cost + more + 3, audit + "R", at + 1, (*out, (new, text))))


def plain(rows):
    out = []
    conv_of = lambda r: (r[0] is not None, r[0] or 0)
    after = list(damaged(rows))
    for conv in sorted({r[0] for r in rows}, key=lambda c: (c is not None, c or 0)):
        own = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).hexdigest()))
        seen, marked = set(), []
        for _, _, role, text in own:
            body = text.rstrip(BLANK)
            fault = "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = {r[1] for r in own} - {None}
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, left = cheapest(marked)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        faults = [sum(m[2] == x for m in marked) for x in "bdt"]
        out.append(str((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *faults, illegal, cost, audit, sha)))
    return sorted(out)


def talks(n, seed, most=7):
    r = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", None], ["Yes.", "No!", "So what?", "open end", "", " \n", None, "Fine. \t", "é!"]
    return [(conv, turn, r.choice(roles), r.choice(texts)) for conv in range(n) for turn in sorted(r.choices([None, *range(9)], k=r.randint(1, most)), key=lambda t: -1 if t is None else t)]


def got(spark, rows, parts=3):
    table = spark.createDataFrame(rows, TYPE).repartition(parts).withColumns({"pos": F.lit(1), "key": F.lit("x"), "fault": F.lit(None), "copy": F.lit("y")})
    found = repair.repaired(table)
    assert found.columns == [c.split()[0] for c in repair.RESULT.split(", ")]
    return sorted(str(tuple(r)) for r in found.collect())


@pytest.mark.parametrize("block", [1000, 2])
def test_against_trying_all_edits(spark, monkeypatch, block):
    """Also in blocks of two rows whose matrices are multiplied in several rounds."""
    monkeypatch.setattr(repair, "BLOCK_ROWS", block)
    monkeypatch.setattr(repair, "FAN", 2)
    rows = talks(60, 1) + [(None, t, "user", "Null id.") for t in (1, None, 3)] + [(900, 5, "user", "Twice."), (900, 5, "user", "Twice.")]
    # Conversations that lose all rows.
    gone = [c for c in range(1000, 1400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    rows += [(c, 0, "user", "Lost.") for c in gone]
    assert gone and got(spark, rows) == plain(rows)


def test_no_rows(spark):
    assert got(spark, []) == []


def test_blocks_equal_one_block():
    """Long conversations: matrices of blocks, multiplied in any grouping, give what one block gives."""
    r = random.Random(5)
    rows = [(t // 2, r.choice("uuaas x"), r.choice(["", "", "", "t", "b", "d"])) for t in range(300)]
    whole = repair.summary_of(rows)
    parts = [repair.summary_of(rows[i : i + 37]) for i in range(0, 300, 37)]
    left = parts[0]
    for p in parts[1:]:
        left = repair.merged(left, p)
    right = parts[-1]
    for p in reversed(parts[:-1]):
        right = repair.merged(p, right)
    assert left == right == whole
    assert repair.solved(whole["cells"]) == repair.solved(left["cells"])


def test_a_long_conversation_and_text(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_ROWS", 64)
    rows = [(7, t, ["user", "assistant"][t % 2], f"Number {t}. " + "word " * (200_000 if t == 11 else 1) + ".") for t in range(700)]
    many = got(spark, rows, 5)
    monkeypatch.setattr(repair, "BLOCK_ROWS", 100_000)
    assert len(many) == 1 and many == got(spark, rows, 2)
