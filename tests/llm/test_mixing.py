import re
from collections import defaultdict

from marketlake.llm import mixing as M


def fill(sizes):
    """Clamp-and-reshare rounds, one by one."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, clamped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in clamped]
        rest = total - sum(3 * sizes[s] for s in clamped)
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {**{s: 3.0 * sizes[s] for s in clamped}, **share}
        clamped |= over


def corpus():
    rows = [(i, "w " * (1 + i * 7 % 90), f"src{i % 5}" if i % 3 else "hot") for i in range(600)]
    rows += [(1000, "one two", "tiny"), (1001, None, "empty"), (1002, " \t", "empty"), (1003, "a b c", None),
             (None, "d e", None), (1004, "rep eat", "src1"), (1004, "rep eat", "src1"), (1005, "x " * 20_000, "src2")]
    return rows


def test_targets_and_taken_words(docs):
    rows = corpus()
    got = M.mix_sources(docs(rows), bucket_rows=16).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want, taken = fill(dict(sizes)), defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5


def test_bucket_size_and_reruns_change_nothing(docs):
    key = lambda df: sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in df.collect())
    rows = corpus()
    assert key(M.mix_sources(docs(rows), bucket_rows=16)) == key(M.mix_sources(docs(rows[::-1])))


def test_written_mix(docs):
    rows = corpus()
    frame = docs(rows)
    out = M.write_mix(frame)
    assert out.columns == frame.columns
    copies = defaultdict(int)
    for r in out.select("doc_id", "source").collect():
        copies[(r["doc_id"], r["source"])] += 1
    plan = {(r["doc_id"], r["source"]): r for r in M.mix_sources(frame).collect()}
    for k, r in plan.items():
        if k != (1004, "src1"):
            assert copies[k] == (1 if r["size"] == 0 else -(-r["taken"] // r["size"]))


def test_empty_table(docs):
    assert M.mix_sources(docs([])).count() == 0 and M.write_mix(docs([])).count() == 0
