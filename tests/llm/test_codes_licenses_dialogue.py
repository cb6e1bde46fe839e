"""Vector codes, licence scans and dialogue repair against brute force on small inputs with nulls, ties, repeated rows,
empty tables, very long values and clashing extra columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from lumigrid.llm import dialogue, licenses, lloyd

# 11 vector codes


VECTORS = "vec_id long, embedding array<double>, label string, code string, part int"


def vectors_of(seed: int, n: int, dim: int = 32) -> list:
    rng = np.random.default_rng(seed)
    rows = [(i * 3 % n, rng.normal(0, 1, dim).round(3).tolist(), f"l{i % 3}" if i % 7 else None, "x", 1) for i in range(n)]
    rows += [rows[5], rows[5], (rows[6][0], rows[7][1], "l1", "x", 1)]  # repeated rows, and an id with two vectors
    rows += [(None, rows[0][1], "l0", "x", 1), (9001, None, "l0", "x", 1), (9002, [1.0, None] * (dim // 2), "l0", "x", 1), (9003, [math.nan] * dim, "l0", "x", 1), (9004, [math.inf] + [0.0] * (dim - 1), "l0", "x", 1)]
    return [*rows, (9005, [1.0, -2.0, 3.0], "short", "x", 1), (9006, [], "short", "x", 1), (9007, [1e30, -1e30] + [0.5] * (dim - 2), "far", "x", 1)]


def plain_lloyd(rows: list, parts: int, entries: int, rounds: int, scale: int) -> tuple[list, list]:
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = max(1, -(-max((len(r[1]) for r in rows), default=0) // parts))
    most = math.isqrt(2**62 // (width * parts)) // 2
    whole = [[math.floor(max(min(x * scale, float(most)), float(-most))) for x in r[1]] + [0] * (width * parts - len(r[1])) for r in rows]
    cut = [[tuple(w[p * width : (p + 1) * width]) for p in range(parts)] for w in whole]
    by_id: dict = {}
    for r, w, c in zip(rows, whole, cut, strict=True):
        if r[0] is not None and (r[0] not in by_id or w < by_id[r[0]][0]):
            by_id[r[0]] = (w, c)
    starts = [by_id[i][1] for i in sorted(by_id)[:entries]]
    books = [[s[p] for s in starts] for p in range(parts)]

    def assign() -> list:
        far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
        return [[min((far(x, c), e) for e, c in enumerate(books[p])) for p, x in enumerate(v)] for v in cut]

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            held = collections.defaultdict(list)
            for v, a in zip(cut, got, strict=True):
                held[a[p][1]].append(v[p])
            books[p] = [tuple(sum(x) // len(held[e]) for x in zip(*held[e], strict=True)) if e in held else c for e, c in enumerate(books[p])]
    got = assign()
    return [(r[0], r[2], bytes(e for _, e in a), sum(d for d, _ in a)) for r, a in zip(rows, got, strict=True)], books


@pytest.mark.parametrize(("n", "rounds"), [(90, 2), (8, 2), (40, 5)])
def test_codes_equal_plain_rounds(spark, n, rounds):
    rows = vectors_of(n, n)
    random.Random(1).shuffle(rows)
    codes, books = lloyd.fitted(spark.createDataFrame(rows, VECTORS).repartition(5), parts=4, entries=16, rounds=rounds)
    want, plain_books = plain_lloyd(rows, 4, 16, rounds, 256)
    assert [[tuple(e) for e in b] for b in books.tolist()] == plain_books
    assert collections.Counter((r["vec_id"], r["label"], bytes(r["code"]), r["error"]) for r in codes.collect()) == collections.Counter(want)


def test_code_digest(spark):
    rows = vectors_of(3, 200)
    got = lloyd.digest(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    want, books = plain_lloyd(rows, 16, 64, 2, 256)
    by_label = collections.Counter()
    for _, label, _, error in want:
        by_label[label] += error
    said = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    assert collections.Counter(tuple(r) for r in got) == collections.Counter((i, c.hex(), e, by_label[label], said) for i, label, c, e in want)
    assert lloyd.digest(spark.createDataFrame([], VECTORS)).collect() == []
    assert lloyd.digest(spark.createDataFrame(rows[-7:-6], VECTORS)).collect() == []  # nothing that counts


def test_only_changed_parts_are_sent(spark):
    rng = np.random.default_rng(4)
    books = np.array([[[0, 0], [100, 100]], [[0, 0], [50, -50]]])
    x = rng.integers(-20, 120, (60, 4))
    rows = spark.createDataFrame([(i, "a", v.tolist(), None) for i, v in enumerate(x)], "vec_id long, label string, x array<int>, code binary").coalesce(1)
    first = lloyd.moved(rows, books).cache()
    state, sent = first.where("part is null").select("vec_id", "label", "x", "code"), first.where("part is not null")
    assert sum(r["n"] for r in sent.collect()) == 60 * 2 and state.count() == 60
    assert lloyd.moved(state, books).where("part is not null").count() == 0  # nothing changed, nothing is sent
    other = books.copy()
    other[1, 1] = [60, -40]
    again = lloyd.moved(state, other).where("part is not null").collect()
    assert all(r["part"] == 1 for r in again) and sum(r["n"] for r in again) == 0  # what one entry gains, another loses
    total = lloyd.added(sent.select("part", "entry", "n", "sums"), spark.createDataFrame(again, sent.schema).select("part", "entry", "n", "sums"), 2)
    codes, _ = lloyd.nearest(x.reshape(60, 2, 2), other)
    for r in total.collect():
        mine = codes[:, r["part"]] == r["entry"]
        assert r["n"] == mine.sum() and r["sums"] == x.reshape(60, 2, 2)[mine, r["part"]].sum(0).tolist()


def test_a_restored_vector_is_near(spark):
    rows = vectors_of(8, 301)[:301]
    codes, books = lloyd.fitted(spark.createDataFrame(rows, VECTORS), parts=16, entries=64)
    by = {r[0]: np.array(r[1]) for r in rows}
    errors = [((lloyd.restored(bytes(r["code"]), books) - by[r["vec_id"]]) ** 2).sum() / (by[r["vec_id"]] ** 2).sum() for r in codes.collect()]
    assert np.mean(errors) < 0.2


# 12 licence scans


DOCS = "doc_id long, text string, places string, label string, n_words int"
MIT = licenses.TEMPLATES[0].text
TEXTS = [
    (1, "Released UNDER the\nMIT License."), (2, "This work is licensed under the GNU General Public License, version 3."), (3, None), (4, ""), (5, " \t\n!"), (6, "cc-by-NC 4.0 cc by nc cc by\xa0nc"),
    (7, "under the mit under the mit license apache license version 2 apache license version 2.0"), (8, MIT), (9, "x " * 3000 + MIT.replace("Software", "Program") + " y" * 3000), (10, "é under the mit licenseé"),
    (11, "the license of a version is under the public software " * 40), (12, MIT.replace("free of charge", "for a fee")), (13, (MIT + " . ") * 30), (None, "under the mit license"), (1, "Released UNDER the\nMIT License."), (14, "licensed under the " * 20_000 + "mit license"),
    (15, "Permission is hereby granted, free of charge"), (16, "\U0001f600 naïve İ Under The MIT License \x00 Under\x00the\x7fMIT license"),
]


def plain_words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


def plain_base(text):
    said = plain_words(text)
    at = [(i, label) for phrase, label in licenses.BASE for i in range(len(said)) if said[i : i + len(phrase.split())] == phrase.encode().split()]
    return len(said), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({label for _, label in at}))


def test_licences_equal_brute_force(spark):
    got = licenses.digest(spark.createDataFrame([(i, t, "x", "y", 0) for i, t in TEXTS], DOCS).repartition(4)).collect()
    want = collections.Counter((i, *plain_base(t)) for i, t in TEXTS)
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == want
    by = {r["doc_id"]: r for r in got}
    labels = {i: by[i]["labels"] for i in (1, 2, 5, 6, 8, 9, 11, 12, 13, 14, 15)}
    assert labels == {1: "mit", 2: "gpl-3", 5: "", 6: "cc-by-nc", 8: "mit", 9: "mit", 11: "", 12: "", 13: "mit", 14: "mit", 15: ""}
    assert all(0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "") and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)
    assert by[8]["score"] == 1 and 0.75 <= by[9]["score"] < 1
    assert licenses.digest(spark.createDataFrame([], DOCS)).collect() == []


def test_every_place_of_a_template(spark):
    r = licenses.scan(spark.createDataFrame([(1, (MIT + " . ") * 30)], "doc_id long, text string")).first()
    n = len(plain_words(MIT))
    assert [(p["start"], p["end"]) for p in r["places"] if p["label"] == "mit"] == [(k * n, (k + 1) * n) for k in range(30)]


def test_each_template_finds_itself_and_edited_copies():
    index = licenses.Index().weighed(1000, {})
    rng = random.Random(3)
    for t in licenses.TEMPLATES:
        assert (t.label, 1.0) in {(p[0], p[4]) for p in index.found(("before " + t.text + " after").encode())[1]}, t
    for t in (t for t in licenses.TEMPLATES if len(t.text) > 200):
        keys = {w for k in t.keys for w in k.split()}
        said = [w.decode() for w in plain_words(t.text)]
        free = [i for i, w in enumerate(said) if w not in keys]
        for i in sorted(rng.sample(free, 2), reverse=True):
            said.insert(i, "indeed") if rng.random() < 0.5 else said.__setitem__(i, "other")
        assert t.label in {p[0] for p in index.found(" ".join(said).encode())[1]}, t


def test_counts_are_of_all_documents(spark):
    docs = spark.createDataFrame([(b"mit mit license",), (b"MIT x",), (b"",)], "raw binary").repartition(3)
    index = licenses.Index()
    n, counts = licenses.counted(docs, index)
    assert n == 3 and counts == {index.vocabulary[b"mit"]: 2, index.vocabulary[b"license"]: 1}


# 13 dialogue repair


TURNS = "conv_id long, turn long, role string, text string, audit string, present string"


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text, role = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text, "user" if d == 4 else role
        out += [(c, t, role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return out


def plain_repair(turns):
    """turns (turn, role, text) in order: the report, from the end of the conversation backwards."""
    seen, faults = set(), []
    for _, role, text in turns:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None)
        seen.add((role, text))
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    due = {0: "u", 1: "u", 2: "a", 3: "u"}
    best = {s: (0, "", ()) if s in (0, 3) else (10**9, "~", ()) for s in range(4)}

    def inserted(best):
        for _ in range(3):
            best = {s: min(best[s], (best[step[s, due[s]]][0] + 2, "I" + best[step[s, due[s]]][1], ({"u": "user:", "a": "assistant:"}[due[s]], *best[step[s, due[s]]][2]))) for s in best}
        return best

    best = inserted(best)
    for (_, role, text), fault in reversed(list(zip(turns, faults, strict=True))):
        cut, after = int(fault == "truncated"), {}
        for s in range(4):
            ways = [(best[s][0] + 3, "D" + best[s][1], best[s][2])]
            if fault not in ("blank", "duplicate"):
                t = best[step[s, due[s]]]
                ways.append((t[0] + 2 + cut, "R" + t[1], ({"u": "user:", "a": "assistant:"}[due[s]] + text, *t[2])))
                if (s, role[:1]) in step:
                    t = best[step[s, role[:1]]]
                    ways.append((t[0] + cut, "K" + t[1], (f"{role}:{text}", *t[2])))
            after[s] = min(ways)
        best = inserted(after)
    cost, audit, said = best[0]
    known = [t for t, _, _ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()), said


def conversations(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.4 else ("assistant" if t % 2 else "user")
            role = rng.choice(["system", "tool", "", None, "User", "u"]) if rng.random() < 0.15 else role
            text = rng.choice(["Yes.", "no", "why? \n", " \t", "", None, "é!", f"turn {t}."])
            turn = None if rng.random() < 0.1 else rng.choice([t, t, t + rng.randint(0, 3)])
            rows.append((c if c else None, turn, role, text))
    return rows


def in_order(rows):
    return sorted(((t, r, x) for t, r, x in rows), key=lambda y: (y[0] is not None, y[0] or 0, y[1].encode(), y[2].encode()))


@pytest.mark.parametrize(("seed", "n", "longest"), [(1, 120, 9), (2, 40, 3), (3, 3, 700)])
def test_repairs_equal_a_plain_search(spark, seed, n, longest):
    rows = conversations(seed, n, longest)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS).repartition(3)
    by = collections.defaultdict(list)
    for c, t, r, x in damaged(rows):
        by[c].append((t, r, x))
    got = dialogue.digest(df).collect()
    assert sorted((r["conv_id"] is None, r["conv_id"]) for r in got if r["conv_id"] is not None) == sorted({(False, r[0]) for r in rows if r[0] is not None})
    for r in got:
        assert tuple(r)[1:] == plain_repair(in_order(by[r["conv_id"]]))[0], r["conv_id"]
    assert len(got) == len({r[0] for r in rows})


def test_repaired_turns(spark):
    rows = conversations(5, 60, 12)
    cut = dialogue.damaged(spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS))
    by = collections.defaultdict(list)
    for c, t, r, x in damaged(rows):
        by[c].append((t, r, x))
    said = collections.defaultdict(dict)
    for r in dialogue.repaired(cut, dialogue.report(cut)).collect():
        said[r["conv_id"]][r["place"]] = f"{r['role']}:{r['text']}"
    for c in {r[0] for r in rows}:
        assert [said[c][k] for k in range(len(said[c]))] == list(plain_repair(in_order(by[c]))[1])


def test_lost_and_empty_conversations(spark):
    lost = next(c for c in range(1000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 == 0 for t in (1,)))
    nothing = hashlib.sha256(b"").hexdigest()
    got = dialogue.digest(spark.createDataFrame([(lost, 1, "user", "Hi.")], "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r) for r in got] == [(lost, 0, 0, 0, 0, 0, 0, "", nothing)]
    assert dialogue.digest(spark.createDataFrame([], TURNS)).collect() == []


def test_a_conversation_that_outgrows_batches(spark, monkeypatch):
    """Stretches of 5 turns in batches of 12: ways are carried from batch to batch, also over ties."""
    monkeypatch.setattr(dialogue, "DEPTH", 5)
    monkeypatch.setattr(dialogue, "TURNS", 12)
    import pyarrow as pa

    for seed in range(40):
        rows = [r for r in conversations(seed + 100, 3, 60) if r[0] is not None]
        streamed = []
        for c in sorted({r[0] for r in rows}):
            seen = set()
            for t, r, x in in_order([(t, r or " ", x or " ") for cc, t, r, x in rows if cc == c]):
                end = x.rstrip(" \t\n\x0b\x0c\r")
                streamed.append((c, t, r, x, 1 if not end else 2 if (r, x) in seen else 3 if end[-1] not in ".!?" else 0))
                seen.add((r, x))
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*streamed, strict=True)], ["conv_id", "turn", "role", "text", "fault"])
        out = [tuple(r.values()) for b in dialogue._stream(iter([batch]), list("abcdefghij"), pa.int64()) for r in b.to_pylist()]
        for r in out:
            assert r[1:9] == plain_repair([(t, ro, x) for c, t, ro, x, _ in streamed if c == r[0]])[0]
        assert len(out) == len({c for c, *_ in streamed})
