"""Language-model scores, conversation repair and the prefix trie against plain Python."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from awkward import awkward_docs, awkward_texts, docs_of, empty_docs, prose
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storewake.llm import conversation_repair, lm_scoring, prefix_trie
from storewake.llm.common import table
from storewake.llm.queries import QUERIES

SPACE = re.compile(r"[\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
TALK = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("node", T.StringType()),
        T.StructField("depth", T.StringType()),
        T.StructField("gone_", T.StringType()),
        T.StructField("step", T.StringType()),
    ]
)


def talk_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], TALK)


# language model


def plain_tokens(text):
    return [w for w in SPACE.split((text or "").translate(LOWER)) if w] + [None]


def is_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def plain_base(rows):
    counts = Counter()
    for i, text in rows:
        if not is_out(i):
            counts.update(plain_tokens(text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, text in rows:
        tokens = plain_tokens(text)
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        out.append((i, is_out(i), len(tokens), sum(counts[t] > 0 for t in tokens), n, round(base, 6)))
    return Counter(out)


def plain_model(rows, factor):
    """The bigram model with exact counts, quantised by the ladder, and no filter."""
    steps = lm_scoring.ladder(factor)

    def level(count):
        return int(np.searchsorted(steps, count, "right"))

    def seen(count):
        return lm_scoring.middles(factor)[level(count)]

    words, pairs = Counter(), Counter()
    taught = [plain_tokens(text) for i, text in rows if not is_out(i)]
    for tokens in taught:
        words.update(tokens)
        pairs.update(zip(["<start>", *tokens], tokens, strict=False))
    words["<start>"] = words[None]
    n = sum(words.values()) - words["<start>"]
    v = len(words) - 1
    single = {w: (seen(c) + 0.5) / (n + 0.5 * (v + 1)) for w, c in words.items()}
    unseen = 0.5 / (n + 0.5 * (v + 1))
    histogram = np.zeros((len(steps) + 1, lm_scoring._BINS))
    for tokens in taught:
        for h, w in zip(["<start>", *tokens], tokens, strict=False):
            total = seen(words[h])
            share = max(min(seen(pairs[h, w]), total) - 1, 0) / max(total - 1, 1)
            at = 0 if share == 0 else math.floor(math.log2(share / single[w]) * 8) + lm_scoring._BINS // 2
            histogram[level(words[h]), min(max(at, 0), lm_scoring._BINS - 1)] += 1
    weights = lm_scoring.fitted_weights(histogram)
    out = []
    for _, text in rows:
        tokens, total = plain_tokens(text), 0.0
        for h, w in zip(["<start>", *tokens], tokens, strict=False):
            p, c = single.get(w, unseen), seen(words[h])
            if c:
                a = weights[level(words[h])]
                p = a * min(seen(pairs[h, w]), c) / c + (1 - a) * p
            total += math.log10(p)
        out.append(total)
    return out


def test_weights_are_the_likeliest():
    r = random.Random(4)
    histogram = np.zeros((3, lm_scoring._BINS))
    histogram[1, [0, 300, 256, 280]] = [50, 10, 7, 30]
    histogram[2, 400] = 5
    made = lm_scoring.fitted_weights(histogram)
    ratio = 2.0 ** ((np.arange(lm_scoring._BINS) - lm_scoring._BINS // 2 + 0.5) / 8)
    ratio[0] = 0
    worth = lambda a: (histogram[1] * np.log(1 - a + a * ratio)).sum()
    assert all(worth(made[1]) >= worth(r.random() * 0.999) - 1e-9 for _ in range(500))
    assert made[0] == 0 and made[2] > 0.99


def prose_rows():
    r = random.Random(5)
    words = ["".join(r.choices("abcde", k=r.randint(1, 4))) for _ in range(300)]
    rows = [(i, " ".join(r.choices(words, k=r.randint(0, 80)))) for i in range(150)]
    return rows + [(i + 1000, t) for i, t in rows[:40]] + awkward_texts()


@pytest.mark.parametrize(("broadcast_bytes", "head"), [(1 << 30, 1 << 18), (0, 40)])
def test_scores(spark, broadcast_bytes, head):
    rows = prose_rows()
    out = lm_scoring.scored(docs_of(spark, rows), broadcast_bytes=broadcast_bytes, head_words=head).collect()
    made = Counter(
        (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out
    )
    assert made == plain_base(rows)
    wanted = sorted(zip(map(str, [i for i, _ in rows]), plain_model(rows, lm_scoring.LADDER), strict=True))
    got = sorted((str(r.doc_id), r.score) for r in out)
    # false positives of the filter move single tokens, and with them the weights a little
    off = [abs(a[1] - b[1]) / (1 + abs(b[1])) for a, b in zip(got, wanted, strict=True)]
    assert sorted(off)[len(off) // 2] < 0.003 and max(off) < 0.1


def test_orders_agree_between_both_ways(spark):
    docs = docs_of(spark, prose_rows())
    both = [
        sorted((str(r.doc_id), round(r.score, 6)) for r in lm_scoring.scored(docs, order=3, broadcast_bytes=b).collect())
        for b in (1 << 30, 0)
    ]
    assert both[0] == both[1]


@pytest.mark.parametrize("bucket_bytes", [16 << 20, 4000])
def test_counts_are_never_too_low(spark, monkeypatch, bucket_bytes):
    monkeypatch.setattr(lm_scoring, "BUCKET_BYTES", bucket_bytes)
    rows = prose_rows()
    made = lm_scoring.count_filter(docs_of(spark, rows).select("text"), order=2)
    assert made.buckets > 1 or bucket_bytes > 4000
    probe = lm_scoring.Probe(*lm_scoring.collected(made))
    found = Counter()
    for tokens in lm_scoring.token_slices(pa.array([t for _, t in rows]), 2):
        for _, _, keys in lm_scoring._keys(tokens):
            found.update(keys.tolist())
    keys, n = np.array(list(found), np.uint64), np.array(list(found.values()))
    levels, exact = probe.levels(keys), lm_scoring._levels(n, made.factor)
    assert (levels >= exact).all()
    assert (levels == exact).mean() > 0.95
    fresh = np.random.default_rng(1).integers(0, 1 << 62, 100_000).astype(np.uint64)
    assert (probe.levels(fresh) > 0).mean() < (0.04 if bucket_bytes == 4000 else 0.02)
    assert made.bytes == len(probe.bits)


def test_slices_cut_long_texts_between_words(monkeypatch):
    texts = ["", None, "A b  c", "x" * 500, prose(2, 200), " \n ", "end", "ä ö " * 50]
    whole = list(lm_scoring.token_slices(pa.array(texts), 3))
    monkeypatch.setattr(lm_scoring, "SLICE", 16)
    cut = list(lm_scoring.token_slices(pa.array(texts), 3))
    assert len(cut) > len(whole) == 1
    for field in ("words", "texts"):
        assert np.array_equal(np.concatenate([getattr(t, field) for t in cut]), getattr(whole[0], field))
    for k in range(2):
        assert np.array_equal(np.concatenate([t.before[k] for t in cut]), whole[0].before[k])


def test_model_is_better_than_single_words(spark, sf_dir):
    out = [r for r in QUERIES["op11_lm_scoring"](spark, sf_dir).collect() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_scores_of_an_empty_table_and_without_training_rows(spark):
    assert lm_scoring.scored(empty_docs(spark)).count() == 0
    only = next(i for i in range(100) if is_out(i))
    (row,) = lm_scoring.scored(docs_of(spark, [(only, "a b")])).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)


# conversation repair


def cheapest(rows):
    """Least (cost, audit) by search over all edit strings; rows are (initial, must go, truncated)."""
    heap, settled = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if at == len(rows) and state in conversation_repair.ACCEPTING:
            return cost, audit
        if (at, state) in settled:
            continue
        settled.add((at, state))
        steps = conversation_repair.STEPS[state]
        for to in "ua":
            if to in steps:
                heapq.heappush(heap, (cost + 2, audit + "I", at, steps[to]))
        if at < len(rows):
            initial, must_go, truncated = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state))
            if not must_go:
                if initial in steps:
                    heapq.heappush(heap, (cost + truncated, audit + "K", at + 1, steps[initial]))
                for to in "ua":
                    if to in steps:
                        heapq.heappush(heap, (cost + truncated + 2, audit + "R", at + 1, steps[to]))


def test_repair_equals_full_search():
    r = random.Random(1)
    for _ in range(1500):
        rows = [(r.choice(["s", "u", "a", "u", "a", "t", ""]), r.random() < 0.2, r.random() < 0.3) for _ in range(r.randint(0, 25))]
        repair, out = conversation_repair.Repair(), []
        for row in rows:
            out += repair.add((), *row)
        out += repair.finish()
        assert (out[-1].cost if out else 0, "".join(n.edit for n in out)) == cheapest(rows)


def test_repair_holds_unresolved_edits_only():
    r = random.Random(2)
    repair, out = conversation_repair.Repair(), 0
    for _ in range(30_000):
        out += len(repair.add((), r.choice("uuaas"), r.random() < 0.1, r.random() < 0.1))
    assert repair.most < 200
    assert out > 29_900


def plain_damage(rows):
    out, ids = defaultdict(list), []
    for conv, turn, role, text in rows:
        ids.append(conv)
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return set(ids), out


def plain_report(conv, rows):
    rows = sorted(rows, key=lambda r: ((0, 0) if r[0] is None else (1, r[0]), r[1], r[2]))
    seen, marks, faults = set(), [], Counter()
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        fault = (
            "blank" if not re.search(r"[^\x20\x09-\x0D]", text) else "duplicate" if (role, text) in seen
            else "truncated" if solid[-1] not in ".!?" else None
        )
        seen.add((role, text))
        faults[fault] += 1
        marks.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    cost, audit = cheapest(marks)
    state, lines, at = 0, [], 0
    for edit in audit:
        if edit != "I":
            _, role, text = rows[at]
            at += 1
        if edit == "D":
            continue
        if edit == "I":
            text = ""
        if edit in "IR":
            role = "assistant" if state == conversation_repair.USER else "user"
        state = conversation_repair.STEPS[state][role[0]]
        lines.append(f"{role}:{text}")
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    checksum = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (
        conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, checksum
    )


REPORT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def awkward_talk():
    r = random.Random(3)
    rows = [
        (conv, turn, r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
         r.choice(["Yes.", "No!", "maybe", "", " \n", None, f"text {conv} {turn}?", "cut\u0085"]))
        for conv in range(120) for turn in r.sample(range(12), r.randint(1, 9))
    ]
    rows += [(None, 1, "user", "a."), (None, None, "assistant", "b"), (7, None, "system", "first."), (7, 3, "user", "x" * 90_000)]
    rows += [(9, 2, "user", "same."), (9, 2, "user", "same."), (9, 2, "user", "same.")]
    rows += [(500, 0, "system", None), (501, 5, None, "lone")]
    return rows


def test_reports_equal_plain_python(spark):
    rows = awkward_talk()
    ids, left = plain_damage(rows)
    frame = conversation_repair.damaged(talk_of(spark, rows))
    made = Counter(tuple(r[c] for c in REPORT) for r in conversation_repair.reports(frame, marker=F.col("gone")).collect())
    assert made == Counter(plain_report(c, left.get(c, [])) for c in ids)


def test_op12_over_the_whole_table(spark, sf_dir):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table(spark, sf_dir, "conversations").collect()]
    ids, left = plain_damage(rows)
    made = Counter(tuple(r[c] for c in REPORT) for r in QUERIES["op12_conversation_repair"](spark, sf_dir).collect())
    assert made == Counter(plain_report(c, left.get(c, [])) for c in ids)


def test_repaired_rows(spark):
    talk = talk_of(spark, [(1, 0, "system", "Be good."), (1, 1, "assistant", "Hi."), (1, 2, "user", ""), (2, 0, "user", "Go")])
    out = conversation_repair.repaired(talk).orderBy("conv_id", "step").collect()
    assert [(r.conv_id, r.edit, r.cost, r.role, r.text, r.fault) for r in out] == [
        (1, "K", 0, "system", "Be good.", None),
        (1, "I", 2, "user", "", None),
        (1, "K", 0, "assistant", "Hi.", None),
        (1, "D", 3, None, None, "blank"),
        (2, "D", 3, None, None, "truncated"),
    ]


def test_repair_of_an_empty_table(spark):
    empty = talk_of(spark, [])
    assert conversation_repair.repaired(empty).count() == 0
    assert conversation_repair.reports(conversation_repair.damaged(empty), marker=F.col("gone")).count() == 0


# prefix trie


def plain_trie(rows, rebuilt=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn, role or "", text or ""))
    digest = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
    for turns in own.values():
        turns.sort(key=lambda t: ((0, 0) if t[0] is None else (1, t[0]), t[1], digest(t[1], t[2])))
    whole = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 6
        base = own.get(conv - int(math.fmod(conv, 100)), [])
        whole[conv] = [t[1:] for t in (base[:h] + turns[h:] if rebuilt else turns)]
    members = defaultdict(list)
    for conv, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
    children = Counter(node[:-1] for node in members if node)
    leaves, saved = Counter(), Counter()
    for node, convs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(convs) - 1) * len(node[-1][1]) if node else 0
    out = []
    for node, convs in members.items():
        ends = sorted(c for c in convs if len(whole[c]) == len(node))
        out.append(
            (min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children[node],
             leaves[node], saved[node], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
        )
    return Counter(out)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def shared_talk():
    r = random.Random(8)
    roles = ["user", "assistant"]
    rows = [(conv, turn, roles[turn % 2], r.choice("abc") * r.randint(1, 2)) for conv in range(0, 330, 3) for turn in range(r.randint(1, 7))]
    rows += [(900 + c, t, "user", "the same first turn") for c in range(60) for t in range(1)]
    rows += [(900 + c, 1, "assistant", f"own {c}") for c in range(60)]
    rows += [(2000, t, "user", f"long {t}") for t in range(150)]
    rows += [(5, None, "system", None), (5, None, None, "x"), (None, 1, "user", "nobody"), (5, 0, "a", "x" * 50_000)]
    rows += [(6, 1, "user", "same"), (6, 1, "user", "same"), (-7, 0, "user", "minus"), (-107, 0, "user", "minus")]
    return rows


@pytest.mark.parametrize(("task_rows", "hot_children"), [(4096, 2000), (8, 3), (60, 10)])
def test_trie_equals_plain_python(spark, task_rows, hot_children):
    rows = shared_talk()
    turns = prefix_trie.rebuilt_turns(prefix_trie.numbered_turns(talk_of(spark, rows)))
    out = prefix_trie.prefix_trie(turns, task_rows, hot_children).collect()
    assert Counter(tuple(r[c] for c in TRIE) for r in out) == plain_trie(rows)
    assert len({bytes(r.node) for r in out}) == len(out)


def test_trie_of_conversations_as_they_are(spark):
    rows = shared_talk()
    turns = prefix_trie.own_turns(prefix_trie.numbered_turns(talk_of(spark, rows)))
    out = prefix_trie.prefix_trie(turns, 16).collect()
    assert Counter(tuple(r[c] for c in TRIE) for r in out) == plain_trie(rows, rebuilt=False)


def test_op13_over_the_whole_table(spark, sf_dir):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table(spark, sf_dir, "conversations").collect()]
    out = QUERIES["op13_prefix_trie"](spark, sf_dir).collect()
    assert Counter(tuple(r[c] for c in TRIE) for r in out) == plain_trie(rows)


def test_trie_of_an_empty_table(spark):
    turns = prefix_trie.rebuilt_turns(prefix_trie.numbered_turns(talk_of(spark, [])))
    assert prefix_trie.prefix_trie(turns).count() == 0


def test_local_split_equals_recursion():
    r = random.Random(6)
    for n in (1, 2, 7, 60, 400):
        parent = [0] + [r.randrange(max(0, at - 3), at) for at in range(1, n)]
        values = [[r.randint(0, 9) for _ in range(n)]]
        size = [r.randint(1, 5) for _ in range(n)]
        wanted = list(values[0])
        for at in range(n - 1, 0, -1):
            wanted[parent[at]] += wanted[at]
        assert prefix_trie._split_locally(size, parent, values) == [wanted]
