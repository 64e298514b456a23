"""Conversation repair against a plain search."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from lapsekit.llm import conversations, queries
from lapsekit.llm.shared import Work, read

SCHEMA = "conv_id long, turn long, role string, text string, idx long, codes int, name string, salt int, lost string"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
ASKED = {"": "u", "s": "u", "u": "a", "a": "u"}
FULL = {"u": "user", "a": "assistant"}


def damage(rows):
    """conv_id -> rows after damage, in order."""
    none = lambda x: " " if x is None else x
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = none(role), none(text)
        fault = zlib.crc32(f"{none(conv)}:{none(turn)}".encode()) % 20
        row = (turn, "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text)
        out[conv] += [] if fault == 0 else [row] * (2 if fault == 3 else 1)
    for found in out.values():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.md5(r[2].encode()).hexdigest()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        ends = re.findall("[^\x20\x09-\x0d]", text)
        out.append("blank" if not ends else "duplicate" if (role, text) in seen else "truncated" if ends[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit), least by both, by trying every edit from the end."""
    n = len(rows)
    best = {(n, s): (0, "") if s in ("", "a") else None for s in ASKED}
    for i in range(n, -1, -1):
        if i < n:
            cut, gone = found[i] == "truncated", found[i] in ("blank", "duplicate")
            for s in ASKED:
                options = [(best[i + 1, s][0] + 3, "D" + best[i + 1, s][1])]
                for letter, to, price in (("K", NEXT.get((s, rows[i][1][:1])), 0), ("R", ASKED[s], 2)):
                    if to and not gone:
                        options.append((best[i + 1, to][0] + price + cut, letter + best[i + 1, to][1]))
                best[i, s] = min(options)
        for _ in range(3):  # insertions
            for s in ASKED:
                if best[i, ASKED[s]] is not None:
                    option = (best[i, ASKED[s]][0] + 2, "I" + best[i, ASKED[s]][1])
                    best[i, s] = option if best[i, s] is None else min(best[i, s], option)
    return best[0, ""]


def repair(rows, audit):
    s, at, out = "", 0, []
    for letter in audit:
        if letter == "D":
            at += 1
            continue
        if letter == "K":
            s, line = NEXT[s, rows[at][1][:1]], f"{rows[at][1]}:{rows[at][2]}"
        else:
            s = ASKED[s]
            line = f"{FULL[s]}:{rows[at][2] if letter == 'R' else ''}"
        at += letter != "I"
        out.append(line)
    assert at == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in out))
    return hashlib.sha256("\n".join(out).encode()).hexdigest()


def plain(rows):
    out = []
    for conv, part in damage(rows).items():
        found, turns = faults(part), {t for t, _, _ in part if t is not None}
        cost, audit = cheapest(part, found)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(part, part[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *(found.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, repair(part, audit)))
    return sorted(out, key=str)


def got(df, spark, work=None):
    out = conversations.repaired(conversations.damaged(df), work or Work(spark, "test"))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted(map(tuple, out.collect()), key=str)


def made(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", 3, "y") for r in rows], SCHEMA).repartition(4)


def corpus(seed, conversations=150, longest=9):
    rng = random.Random(seed)
    roles = ["user", "assistant"] * 6 + ["system", "tool", "", None, "summary", "Ä"]
    texts = ["Yes.", "No", " \t\x0b", "", None, "Why?  ", "ok!\n", "é…", "Long. " * 3000] + [f"text {k}." for k in range(30)]
    out = []
    for conv in range(conversations):
        for turn in range(rng.randrange(1, longest)):
            out.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), rng.choice(roles), rng.choice(texts)))
    return out + [(None, None, None, None), (None, 3, "user", "a"), (None, 3, "user", "a")] + [out[0]] * 3


@pytest.mark.parametrize("seed", [1, 2])
def test_repaired(spark, work, seed):
    rows = corpus(seed)
    assert got(made(spark, rows), spark, work) == plain(rows)
    assert got(made(spark, rows).filter("false"), spark) == []


@pytest.mark.parametrize("chunk", [1, 3, 64])
def test_long_conversations_go_over_many_chunks(spark, work, monkeypatch, chunk):
    monkeypatch.setattr(conversations, "CHUNK", chunk)
    rng = random.Random(chunk)
    rows = [(conv, turn, role, text) for conv, turn, role, text in corpus(9, 30, 60) if conv != 5]
    # no vector converges in runs of one role; equal rows, one turn for all
    rows += [(5, turn, "user", f"line {turn}.") for turn in range(300)] + [(6, None, "assistant", "same!")] * 200
    rows += [(7, 4, rng.choice(["user", "assistant"]), f"t {k}") for k in range(100)]
    assert got(made(spark, rows), spark, work) == plain(rows)


def test_chunks_start_from_speculation_and_converge():
    rng = random.Random(4)
    for _ in range(300):
        codes = bytes(rng.choice([0, 1, 2, 2, 1, 3, 5, 6, 8, 9]) for _ in range(rng.randrange(40)))
        after = conversations.shapes(bytes(rng.choice([0, 1, 2, 6]) for _ in range(rng.randrange(6))), conversations.END)
        before = conversations.shapes(codes, conversations.END)
        assert conversations.rerun(codes, after, conversations.END, before) == conversations.shapes(codes, after)


def test_query(spark, small):
    rows = [tuple(r) for r in read(spark, small, "conversations").select("conv_id", "turn", "role", "text").collect()]
    out = queries.QUERIES["op11_conversation_repair"](spark, small).collect()
    assert sorted(map(tuple, out), key=str) == plain(rows)
