import random

from loomspan.sources import scans
from loomspan.sources.scans import STATE, Registry


def fold(steps):
    """Straight from the rules, a dictionary of files."""
    state, said = {}, []
    for scan in steps:
        changes = {}
        due = [p for p, f in state.items() if f["status"] != "removed" and p not in scan and f["misses"] + 1 >= 2]
        held = len(due) > max(3, 0.05 * sum(f["status"] == "done" for f in state.values()))
        for p, f in state.items():
            if p in scan or f["status"] == "removed":
                continue
            f["misses"] += 1
            changes[p] = "missing" if p not in due else "held" if held else "removed"
            if changes[p] == "removed":
                f["status"] = "removed"
        for p, (size, at, digest) in scan.items():
            f = state.get(p)
            if f and f["status"] == "done" and (f["size"], f["at"]) == (size, at):
                f["misses"] = f["attempts"] = 0
                continue
            gone = f is None or f["status"] == "removed"
            if digest is None:
                tried = 1 if gone else f["attempts"] + 1
                changes[p] = "failed" if tried >= 3 else "retry"
                old = {"size": None, "at": None, "hash": None} if gone else {k: f[k] for k in ("size", "at", "hash")}
                state[p] = {**old, "status": changes[p], "attempts": tried, "misses": 0}
                continue
            if gone or f["hash"] is None:
                changes[p] = "new"
            elif f["hash"] != digest:
                changes[p] = "changed"
            state[p] = {"size": size, "at": at, "hash": digest, "status": "done", "attempts": 0, "misses": 0}
        said.append(changes)
    return state, said


def test_scans_by_the_rules(spark, tmp_path):
    r = random.Random(8)
    steps = []
    for s in range(7):
        there = [p for p in range(60) if r.random() < (0.35 if s == 4 else 0.9)]
        steps.append({f"f{p}": (p, r.choice([1, 1, s]), None if p % 9 == 0 and r.random() < 0.7 else f"h{p}-{r.choice([0, 0, s])}") for p in there})
    kept = Registry(spark, f"file://{tmp_path}/r")
    assert kept.state().count() == 0
    for n, scan in enumerate(steps, 1):
        df = spark.createDataFrame([(p, *x) for p, x in scan.items()], "path string, size long, modified long, hash string").repartition(3)
        assert kept.apply(n, df) and not kept.apply(n, df)
        state, said = fold(steps[:n])
        rows = kept.state().collect()
        assert {x["path"]: (x["size"], x["modified"], x["hash"], x["status"], x["attempts"], x["misses"]) for x in rows} == {p: (f["size"], f["at"], f["hash"], f["status"], f["attempts"], f["misses"]) for p, f in state.items()}
        assert {x["path"]: x["change"] for x in rows if x["change"]} == said[-1]
    assert any("held" in x.values() for x in said) and any("removed" in x.values() for x in said)


def test_twice_in_a_scan_and_nothing_at_all(spark):
    empty = spark.createDataFrame([], STATE)
    twice = spark.createDataFrame([("a", 1, 5, "old"), ("a", 2, 6, "new"), ("b", None, None, None)], "path string, size long, modified long, hash string")
    assert {(r["path"], r["hash"], r["change"]) for r in scans.scanned(empty, twice).collect()} == {("a", "new", "new"), ("b", None, "retry")}
    assert scans.scanned(empty, twice.limit(0)).count() == 0
