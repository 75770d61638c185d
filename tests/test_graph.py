"""Graph operators on small graphs against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from depgraph_spark.graph import DependencyGraph
from depgraph_spark.operators import coupling, gate, incremental, rank
from depgraph_spark.operators.incremental import edge_diff
from depgraph_spark.plans import components
from depgraph_spark.plans.components import longest_levels
from depgraph_spark.plans.cycles import neighbour_pairs, short_cycles, wedges
from depgraph_spark.plans.dynamic import changed_components
from depgraph_spark.operators import graph as lookups
from depgraph_spark.plans import pagerank as power
from depgraph_spark.plans.encode import assign_ids
from depgraph_spark.plans.ranking import rank_desc
from depgraph_spark.sources import graph_store

EDGES = "repo string, src string, dst string, n_refs bigint"
FILES = "repo string, path string, lang string"


def make(spark, pairs, extra=(), repo="r"):
    names = sorted({n for p in pairs for n in p} | set(extra))
    files = spark.createDataFrame([(repo, n, "typescript") for n in names], FILES)
    edges = spark.createDataFrame([(repo, a, b, 1) for a, b in pairs], EDGES)
    return DependencyGraph(files, edges)


def random_pairs(n, m, seed):
    rng = random.Random(seed)
    return sorted({(f"f{rng.randrange(n):03}", f"f{rng.randrange(n):03}") for _ in range(m)})


def importers_of(pairs, start):
    level, frontier, seen = 0, {start}, {}
    while frontier:
        level += 1
        frontier = {a for a, b in pairs if b in frontier and a != start and a not in seen}
        seen.update({f: level for f in frontier})
    return seen


# A ring of five with a tail, two rings joined by one edge, a file importing itself, an isolated file.
CYCLES = [("a1", "a2"), ("a2", "a3"), ("a3", "a4"), ("a4", "a5"), ("a5", "a1"), ("t", "a1"), ("a3", "u")]
CYCLES += [("b1", "b2"), ("b2", "b1"), ("b2", "c1"), ("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("self", "self")]


def test_components(spark):
    g = make(spark, CYCLES, ["alone"])
    comp = {r["path"]: r["comp"] for r in g.components().collect()}
    assert {comp[f"a{i}"] for i in range(1, 6)} == {"a1"}
    assert comp["b2"] == "b1" and comp["c3"] == "c1" and comp["self"] == "self" and comp["alone"] == "alone"
    assert {r["comp"] for r in g.cyclic_clusters().collect()} == {"a1", "b1", "c1"}
    cycles = {r["cycle"] for r in g.bounded_cycles().collect()}
    assert cycles == {"b1 -> b2", "c1 -> c2 -> c3"}
    assert {r["cycle"] for r in g.bounded_cycles(max_length=5).collect()} == cycles | {"a1 -> a2 -> a3 -> a4 -> a5"}
    assert len(g.bounded_cycles(max_cycles=1).collect()) == 1


def test_ring_takes_few_rounds(spark, monkeypatch):
    rounds = []
    counted = components.cut_counted
    monkeypatch.setattr(components, "cut_counted", lambda *a: rounds.append(1) or counted(*a))
    order = list(range(1000))
    random.Random(1).shuffle(order)
    names = [f"n{i:04}" for i in order]
    g = make(spark, list(zip(names, names[1:] + names[:1])))
    assert {r["comp"] for r in g.components().collect()} == {"n0000"}
    assert len(rounds) < 40


@pytest.mark.parametrize("seed,n,m", [(1, 30, 45), (3, 25, 80)])
def test_random_graphs(spark, seed, n, m):
    pairs = random_pairs(n, m, seed)
    g = make(spark, pairs)
    nodes = {x for p in pairs for x in p}
    want = {(f, i, lv) for f in nodes for i, lv in importers_of(pairs, f).items()}
    got = {(r["file"], r["impacted"], r["level"]) for r in g.transitive_dependents().collect()}
    assert got == want
    # One component per set of mutually reachable files, named by its smallest member.
    reach = {(f, i) for f, i, _ in want}
    comp = {f: min([f] + [i for i in nodes if (f, i) in reach and (i, f) in reach]) for f in nodes}
    assert {r["path"]: r["comp"] for r in g.components().collect()} == comp
    # Impact sets agree with plain reachability; totals agree with the sets.
    impact = g.impact().collect()
    assert {(r["file"], r["impacted"]) for r in impact} == reach
    direct = {(b, a) for a, b in pairs if a != b} | {(f, i) for f, i in reach if comp[f] == comp[i]}
    assert {(r["file"], r["impacted"]) for r in impact if r["is_direct"]} == direct
    summary = {r["file"]: r for r in g.impact_summary().collect()}
    assert {f: summary[f]["total_impacted"] for f in nodes} == {f: sum(1 for x, _ in reach if x == f) for f in nodes}
    assert {f: summary[f]["direct"] for f in nodes} == {f: sum(1 for x, _ in direct if x == f) for f in nodes}
    depth = {f: max([r["level"] for r in impact if r["file"] == f], default=0) for f in nodes}
    assert {r["file"]: r["cascade_depth"] for r in g.cascade_depth().collect()} == depth
    # Levels rise along every edge between components.
    level = {r["comp"]: r["level"] for r in g.topological_levels().collect()}
    assert set(level) == set(comp.values())
    for r in g.condensed().collect():
        assert level[r["src_comp"]] > level[r["dst_comp"]]
    some = spark.createDataFrame([("r", f) for f in sorted(nodes)[:3]], "repo string, file string")
    picked = {(r["file"], r["impacted"]) for r in g.impact(some).collect()}
    assert picked == {(f, i) for f, i in reach if f in sorted(nodes)[:3]}
    checked = {r["file"]: (r["total_impacted"], r["direct"]) for r in g.check_safe(some).collect()}
    raw = {f: (sum(1 for x, _ in reach if x == f), sum(1 for a, b in pairs if b == f and a != f)) for f in nodes}
    assert checked == {f: raw[f] for f in sorted(nodes)[:3]}


def test_repositories_do_not_mix(spark):
    one = make(spark, [("a", "b"), ("b", "c")], repo="one")
    two = make(spark, [("c", "b"), ("b", "a")], repo="two")
    g = DependencyGraph(one.files.unionByName(two.files), one.edges.unionByName(two.edges))
    got = {(r["repo"], r["file"], r["impacted"]) for r in g.transitive_dependents().collect()}
    assert got == {
        ("one", "b", "a"), ("one", "c", "b"), ("one", "c", "a"), ("two", "b", "c"), ("two", "a", "b"), ("two", "a", "c"),
    }
    assert g.cyclic_clusters().count() == 0


def test_ids_follow_path_order(spark):
    files = spark.createDataFrame([("r", f"p{i:04}") for i in range(500)], "repo string, path string").repartition(5)
    rows = assign_ids(files).orderBy("id").collect()
    assert [r["path"] for r in rows] == sorted(r["path"] for r in rows)


@pytest.mark.parametrize("hot", [1_000_000, 3])
def test_pagerank(spark, hot):
    pairs = [p for p in random_pairs(30, 90, 5) if p[0] != p[1]] + [("f000", f"f{i:03}") for i in range(1, 25)]
    pairs = sorted(set(pairs))
    g = make(spark, pairs, ["lonely"])
    edges, rows = g._encoded
    ranks = power.pagerank(g.ids.select("id", "repo"), edges, rows, hot_out_edges=hot)
    got = {r["path"]: r["rank"] for r in ranks.join(g.ids, "id").collect()}
    nodes = sorted({x for p in pairs for x in p} | {"lonely"})
    out = {f: [b for a, b in pairs if a == f] for f in nodes}
    pr = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(20):
        idle = sum(pr[f] for f in nodes if not out[f])
        nxt = dict.fromkeys(nodes, 0.15 / len(nodes) + 0.85 * idle / len(nodes))
        for f in nodes:
            for b in out[f]:
                nxt[b] += 0.85 * pr[f] / len(out[f])
        pr = nxt
    assert sum(got.values()) == pytest.approx(1)
    assert got == pytest.approx(pr, abs=1e-12)


def test_updated_pagerank(spark):
    """Imports added, removed and all lost, files new and gone, a part that nothing changed leads to, another repository."""
    region = [p for p in random_pairs(25, 50, 8) if p[0] != p[1]]
    apart = [("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("x3", "f000")]
    old_pairs = sorted({*region, *apart, ("gone", "f001"), ("f002", "gone"), ("lost", "f003"), ("c1", "c2")})
    new_pairs = [p for p in old_pairs if "gone" not in p and p[0] != "lost" and p != region[0]]
    new_pairs = sorted({*new_pairs, ("f010", "new"), ("new", "f004"), ("c2", "c1")})
    old, new, other = make(spark, old_pairs), make(spark, new_pairs, ["lost", "alone"]), make(spark, CYCLES, repo="q")

    def both(g):
        return DependencyGraph(g.files.unionByName(other.files), g.edges.unionByName(other.edges))

    old, new = both(old), both(new)
    diff = edge_diff(old.edges, new.edges)
    state = rank.pagerank_state(old)
    got_state, got = rank.updated_pagerank(state, new.files, new.edges, diff)
    want = {(r["repo"], r["path"]): r["pagerank"] for r in rank.pagerank(new).collect()}
    assert {(r["repo"], r["path"]): r["pagerank"] for r in got.collect()} == pytest.approx(want, abs=2e-9)
    want_state = {(r["repo"], r["path"]): (r["sink"], r["p"]) for r in rank.pagerank_state(new).collect()}
    for r in got_state.collect():
        sink, p = want_state.pop((r["repo"], r["path"]))
        assert r["sink"] == sink and r["p"] == pytest.approx(p, abs=1e-12)
    assert not want_state
    touched = {(r["repo"], r["path"]) for r in power.changed_weights(state, new.files, new.edges, diff).collect()}
    assert ("r", "alone") in touched and ("r", "f004") in touched
    assert not any(repo == "q" or path.startswith("x") for repo, path in touched)
    same = power.changed_weights(state, old.files, old.edges, edge_diff(old.edges, old.edges))
    assert same.count() == 0


def test_rank_with_ties(spark):
    rng = random.Random(3)
    rows = [(f"g{rng.randrange(3)}", float(rng.choice([1, 1, 1, 2, 5, 7]))) for _ in range(300)]
    df = spark.createDataFrame(rows, "repo string, v double").repartition(6)
    got = {(r["repo"], r["v"], r["rank"], r["n"]) for r in rank_desc(df, "repo", "v").collect()}
    want = set()
    for g in {r[0] for r in rows}:
        vs = [v for h, v in rows if h == g]
        want |= {(g, v, 1 + sum(x > v for x in vs), len(vs)) for v in vs}
    assert got == want


def test_percentile_sample(spark):
    df = spark.createDataFrame([("r", f"f{i}", float(i)) for i in range(245)], "repo string, path string, pagerank double")
    third = rank.pagerank_percentile(df).where("rank = 3").first()
    assert (third["n"], third["percentile"]) == (245, 99)


def test_importer_lists(spark):
    g = make(spark, [(f"s{i:03}", "hub") for i in range(200)] + [("s000", "x")])
    rows = lookups.importer_lists(g.edges, block=20).collect()
    hub = [r["importers"] for r in rows if r["file"] == "hub"]
    assert len(hub) > 5 and sorted(x for part in hub for x in part) == [f"s{i:03}" for i in range(200)]


def test_lookups_and_isolated(spark):
    g = make(spark, CYCLES, ["alone"])
    assert [r["path"] for r in lookups.isolated_files(g.files, g.edges).collect()] == ["alone"]
    ask = spark.createDataFrame([("r", "a1"), ("r", "nope")], "repo string, file string")
    assert {r["dependent"] for r in lookups.direct_dependents(ask, g.edges).collect()} == {"a5", "t"}
    assert [r["file"] for r in lookups.unknown_files(ask, g.files).collect()] == ["nope"]
    unstable = {r["path"]: r["instability"] for r in lookups.instability(g.degrees()).collect()}
    assert unstable["alone"] is None and unstable["t"] == 1.0 and unstable["u"] == 0.0


def test_store_round_trip(spark, tmp_path):
    g = make(spark, CYCLES, ["alone"])
    graph_store.write_graph(g, str(tmp_path / "g"))
    back = graph_store.read_graph(spark, str(tmp_path / "g"))
    assert back.edges.exceptAll(g.edges.select(back.edges.columns)).count() == 0
    assert back.files.count() == g.files.count()
    assert graph_store.read_table(spark, str(tmp_path / "g"), "components").count() == g.files.count()
    summary = lambda graph: sorted(map(tuple, graph.impact_summary().collect()))
    assert back.known_components is not None and summary(back) == summary(g)
    # Stored tables meet without an exchange.
    joined = back.files.join(back.edges.withColumnRenamed("src", "path").hint("merge"), ["repo", "path"])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    with pytest.raises(FileExistsError):
        graph_store.write_graph(g, str(tmp_path / "g"))


def test_killed_write_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "g")
    g, bigger = make(spark, CYCLES, ["alone"]), make(spark, CYCLES, ["alone", "another"])
    graph_store.write_graph(g, path, buckets=4)
    with monkeypatch.context() as broken:
        broken.setattr(type(bigger), "components", lambda self: self.files.select(F.raise_error(F.lit("killed")).alias("comp"), "repo", "path"))
        with pytest.raises(Exception, match="killed"):
            graph_store.write_graph(bigger, path, mode="overwrite")
    assert graph_store.read_graph(spark, path).files.count() == g.files.count()
    graph_store.write_graph(bigger, path, mode="overwrite")
    assert graph_store.read_graph(spark, path).files.count() == bigger.files.count()
    assert graph_store.versions(spark, path) == [(0, 4), (1, 4)]


def commit_table(spark, commits):
    rows = [("r", c, f) for c, files in commits.items() for f in files]
    return spark.createDataFrame(rows, "repo string, commit_id bigint, file string")


def test_coupling_moves_lists_not_pairs(spark, monkeypatch):
    commits = {n: [f"f{i:02d}" for i in range(n % 7, n % 7 + n % 5 + 2)] for n in range(60)}
    commits[99] = [f"f{i:02d}" for i in range(25)]
    table = commit_table(spark, commits)
    kept = [files for files in commits.values() if len(files) <= 20]
    pairs = Counter((a, b) for files in kept for a in files for b in files if a != b)
    often = Counter(f for files in kept for f in files)
    want = {(a, b, n, n / often[a]) for (a, b), n in pairs.items()}
    mined = coupling.change_coupling(table)
    plan = mined._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert moved and not any("other" in line or "file1" in line for line in moved)
    assert {(r["file"], r["other"], r["co_changes"], r["confidence"]) for r in mined.collect()} == want
    # Files of more than nine commits count as files of very many: dealt by their partners, with the same result.
    monkeypatch.setattr(coupling, "COMMITS_PER_TASK", 9)
    edges = spark.createDataFrame([("r", "f00", "f01", 1), ("r", "f06", "f03", 1)], "repo string, src string, dst string, n_refs long")
    flagged = coupling.change_coupling(table, edges=edges)
    linked = {("f00", "f01"), ("f01", "f00"), ("f06", "f03"), ("f03", "f06")}
    assert {tuple(r)[1:] for r in flagged.collect()} == {(*w, w[:2] in linked) for w in want}
    joined = coupling.coupling_in_graph(coupling.change_coupling(table), edges)
    assert sorted(map(tuple, flagged.collect())) == sorted(map(tuple, joined.select(flagged.columns).collect()))
    apart = coupling.hidden_coupling(flagged)
    assert sorted(map(tuple, apart.collect())) == sorted(
        map(tuple, coupling.hidden_coupling(mined, edges).select(apart.columns).collect())
    )


def test_coupling(spark):
    commits = {1: "abc", 2: "ab", 3: "ab", 4: "a", 5: [f"m{i}" for i in range(21)] + ["a", "b"]}
    got = {
        (r["file"], r["other"]): (r["co_changes"], r["confidence"])
        for r in coupling.change_coupling(commit_table(spark, commits), min_support=2).collect()
    }
    assert got == {("a", "b"): (3, 0.75), ("b", "a"): (3, 1.0)}
    pairs = {(r["file1"], r["file2"]): r["co_changes"] for r in coupling.co_change_pairs(commit_table(spark, commits)).collect()}
    assert pairs == {("a", "b"): 3, ("a", "c"): 1, ("b", "c"): 1}
    g = make(spark, [("a", "b")])
    mined = coupling.change_coupling(commit_table(spark, commits))
    assert coupling.hidden_coupling(mined.where("co_changes > 1"), g.edges).count() == 0
    assert coupling.hidden_coupling(mined, g.edges).count() == 4
    assert coupling.hidden_coupling(mined, g.edges, top_n=1).count() == 3


WARN = "repo string, id bigint, ts timestamp, file string, risk_level string, summary string, broken_imports array<string>"


def verdicts(spark, pairs, changes, warnings=(), acks=(), commits=None, extra=()):
    """Verdict row per change set; ``changes`` maps a change id to its files, None for no list."""
    g = make(spark, pairs, extra)
    sets = spark.createDataFrame([("r", c, f is not None) for c, f in changes.items()], "repo string, change_id bigint, has_files boolean")
    rows = [("r", c, f, i) for c, files in changes.items() for i, f in enumerate(files or [])]
    listed = spark.createDataFrame(rows, "repo string, change_id bigint, file string, ord int")
    warned = spark.createDataFrame([("r", i, None, *w) for i, w in enumerate(warnings)], WARN)
    acked = spark.createDataFrame([("r", a) for a in acks], "repo string, id bigint")
    mined = coupling.change_coupling(commit_table(spark, commits)) if commits else None
    out = gate.gate_verdict(g, sets, listed, warned, acked, mined)
    return {r["change_id"]: r for r in out.collect()}


# Six hubs with importers keep plain files out of the top five.
HUBS = [(f"i{k}{h}", f"hub{h}") for h in range(6) for k in range(12)]


def test_gate_branches(spark):
    pairs = HUBS + [("x", "y"), ("y", "x"), ("p", "q")]
    warnings = [
        ("w1", "CRITICAL", "bad", []),
        ("w2", "HIGH", "risky", []),
        ("w3", "HIGH", "risky", ["z"]),
        ("w4", "MEDIUM", "hm", []),
        ("w5", "LOW", "eh", []),
        ("w6", "SAFE", "ok", []),
        ("w7", "CRITICAL", "done", []),
    ]
    changes = {i: [f"w{i}"] for i in range(1, 8)}
    changes |= {8: ["x"], 9: ["y", "x"], 10: ["p"], 11: [], 12: None, 13: ["hub0"], 14: ["w3", "w2"], 15: ["gone"]}
    got = verdicts(spark, pairs, changes, warnings, acks=[6], extra=[f"w{i}" for i in range(1, 8)])
    assert {i: got[i]["verdict"] for i in got} == {
        1: "FAIL", 2: "WARN", 3: "FAIL", 4: "WARN", 5: "PASS", 6: "PASS", 7: "PASS", 8: "FAIL", 9: "FAIL", 10: "PASS",
        11: "PASS", 12: "FAIL", 13: "WARN", 14: "FAIL", 15: "PASS",
    }
    assert got[1]["status_line"] == "BUILD BLOCKED — CRITICAL warnings"
    assert got[3]["status_line"] == "BUILD BLOCKED — HIGH warnings with broken imports"
    assert got[9]["status_line"] == "BUILD BLOCKED — CRITICAL warnings, 1 circular dependency(ies)"
    assert got[4]["status_line"] == "PROCEED WITH CAUTION — 1 issue(s) detected"
    assert got[12]["issues"] == 5 and got[12]["unresolved_warnings"] == 6
    assert got[5]["auto_acknowledged"] == 6 and got[4]["auto_acknowledged"] == 0
    assert got[1]["cyclic_sccs"] == 1


def test_gate_cycle_issue_names_first_listed(spark):
    g = make(spark, [("x", "y"), ("y", "x")])
    changes = spark.createDataFrame([("r", 1, "y", 0), ("r", 1, "x", 1)], "repo string, change_id bigint, file string, ord int")
    row = gate.cycle_issues(g, changes).first()
    assert (row["file"], row["description"]) == ("y", "Circular dependency detected (2 files)")


def test_gate_spells_long_cycles_as_rows(spark):
    names = [f"f{i:02}" for i in range(51)]
    g = make(spark, list(zip(names, names[1:] + names[:1])))
    changes = spark.createDataFrame([("r", 1, "f07")], "repo string, change_id bigint, file string")
    assert gate.cycle_issues(g, changes).first()["description"] == "Circular dependency detected (51 files)"
    rows = gate.cycle_members(g, changes).collect()
    assert sorted(r["member"] for r in rows) == names and {r["size"] for r in rows} == {51}


def test_acks_close_warnings_of_their_own_repository(spark):
    rows = [(repo, 1, None, "f", "HIGH", "s", []) for repo in ("r1", "r2")]
    warned = spark.createDataFrame(rows, WARN)
    acked = spark.createDataFrame([("r1", 1)], "repo string, id bigint")
    opened = gate.unacknowledged_warnings(warned, acked)
    assert [r["repo"] for r in opened.collect()] == ["r2"]
    assert [(r["repo"], r["id"]) for r in gate.acknowledge_warnings(warned, acked).collect()] == [("r2", 1)]
    changes = spark.createDataFrame([("r1", 7, "f"), ("r2", 8, "f")], "repo string, change_id bigint, file string")
    issues = gate.warning_issues(gate.warnings_for_files(changes, opened), opened).collect()
    assert [(r["repo"], r["change_id"]) for r in issues] == [("r2", 8)]
    verdicts_ = spark.createDataFrame([("r2", "PASS"), ("r1", "WARN")], "repo string, verdict string")
    assert [(r["repo"], r["id"]) for r in gate.pass_acknowledgements(verdicts_, opened).collect()] == [("r2", 1)]


def test_gate_small_hub_still_warns(spark):
    got = verdicts(spark, [("a", "b")], {1: ["a"]})
    assert got[1]["verdict"] == "WARN" and got[1]["medium"] == 1


def test_gate_coupling_edges(spark):
    commits = {1: "ab", 2: "ab", 3: "ab", **{i: "a" for i in range(4, 11)}, 20: "cd", 21: "cd", 22: "c", 23: "c"}
    pairs = HUBS + [("z", "k")]
    got = verdicts(spark, pairs, {1: ["a"], 2: ["c"], 3: ["a", "b"], 4: ["d"]}, commits=commits, extra="abcd")
    # 3 of 10 is the floor (LOW), 2 of 4 is MEDIUM, files changed together raise nothing.
    assert [(got[i]["low"], got[i]["medium"]) for i in (1, 2, 3, 4)] == [(1, 0), (0, 1), (0, 0), (0, 1)]
    assert [got[i]["verdict"] for i in (1, 2, 3, 4)] == ["PASS", "WARN", "PASS", "WARN"]


def test_many_files_on_one_warned_file_make_one_row_before_the_warnings(spark):
    files = [(f"a/f{i}.go", c) for c in range(3) for i in range(40)]
    changes = spark.createDataFrame([("r", c, f) for f, c in files], "repo string, change_id bigint, file string")
    rows = [("r", i, None, ".go", "HIGH", "s", []) for i in range(50)]
    rows += [("r", 50, None, "a/f1.go", "LOW", "s", []), ("r", 50, None, "f1.go", "LOW", "s", []), ("r", 51, None, "x", "LOW", "s", [])]
    found = gate.warnings_for_files(changes, spark.createDataFrame(rows, WARN))
    got = [(r["change_id"], r["id"]) for r in found.collect()]
    assert sorted(got) == [(c, i) for c in range(3) for i in range(51)]
    # Distinct comes before the warnings are joined; only the id that warns of several files is made distinct after.
    once = gate.warnings_for_files(changes, spark.createDataFrame(rows[:50], WARN))
    top = once._jdf.queryExecution().optimizedPlan().toString().splitlines()[:2]
    assert not any("Aggregate" in line for line in top) and once.count() == 150


def test_coupling_issues_of_listed_and_large_change_sets(spark, monkeypatch):
    commits = {n: [f"f{(n * k) % 13:02d}" for k in range(1, 5)] for n in range(1, 13)}
    mined = coupling.change_coupling(commit_table(spark, commits))
    g = make(spark, [("f01", "f02"), ("f03", "f09")], [f"f{i:02d}" for i in range(11)])
    rows = [("r", c, f"f{i:02d}") for c, n in ((1, 2), (2, 5), (3, 12)) for i in range(n)]
    changes = spark.createDataFrame(rows, "repo string, change_id bigint, file string")
    strong = [(r["file"], r["other"]) for r in mined.collect() if r["confidence"] >= 0.3]
    linked = {("f01", "f02"), ("f02", "f01"), ("f03", "f09"), ("f09", "f03")}
    known = {r["path"] for r in g.files.collect()}
    want = sorted(
        (c, f, o) for _, c, f in rows for a, o in strong
        if a == f and f in known and (f, o) not in linked and ("r", c, o) not in rows
    )
    flagged = coupling.change_coupling(commit_table(spark, commits), edges=g.edges)
    for most in (64, 3):
        monkeypatch.setattr(gate, "LISTED_FILES", most)
        for table in (mined, flagged):
            found = gate.coupling_issues(g, changes, table).collect()
            assert sorted((r["change_id"], r["file"], r["description"].split()[2]) for r in found) == want and want


def test_warning_suffixes_match_brute_force(spark):
    changed = ["src/af3.ts", "f3.ts", "lib/x.ts", "x.ts", "é/f3.ts"]
    warned = ["f3.ts", "home/src/af3.ts", "/x.ts", "b/x.ts", "3.ts", ""]
    a = spark.createDataFrame([("r", f) for f in changed], "repo string, file string")
    b = spark.createDataFrame([("r", f) for f in warned], "repo string, file string")
    got = {(r["file"], r["warned"]) for r in gate.matching_files(a, b).collect()}
    assert got == {(c, w) for c in changed for w in warned if c.endswith(w) or w.endswith(c)}


def test_broken_imports(spark):
    g = make(spark, [("a", "x"), ("b", "x"), ("x", "y"), ("c", "y"), ("d", "a")])
    gone = spark.createDataFrame([("r", 1, "x"), ("r", 1, "b"), ("r", 2, "y")], "repo string, change_id bigint, file string")
    got = {(r["change_id"], r["file"], r["importer"]) for r in incremental.broken_imports(g.edges, gone).collect()}
    assert got == {(1, "x", "a"), (2, "y", "x"), (2, "y", "c")}
    back = spark.createDataFrame([("r", "y")], "repo string, file string")
    assert {r["change_id"] for r in incremental.broken_imports(g.edges, gone, back).collect()} == {1}
    warned = {r["file"]: (r["broken"], r["affected"]) for r in incremental.broken_import_warnings(g, gone).collect()}
    assert warned == {"x": (1, 3), "y": (2, 5)}


def test_invalidation(spark):
    old = make(spark, [("a", "b"), ("b", "c"), ("d", "c"), ("x", "y")]).edges
    new = make(spark, [("a", "d"), ("b", "c"), ("d", "c"), ("x", "y")]).edges
    diff = {(r["src"], r["dst"], r["change"]) for r in incremental.edge_diff(old, new).collect()}
    assert diff == {("a", "b", "removed"), ("a", "d", "added")}
    assert {r["path"] for r in incremental.invalidation_set(old, new).collect()} == {"b", "c", "d"}


# --- plans ---


def test_levels_use_every_step_once(spark):
    """A ladder with shortcuts: each step is taken in one round only."""
    n = 12
    steps = [(i, i + 1) for i in range(n)] + [(i, i + 1 + k) for i in range(n) for k in (2, 5) if i + 1 + k <= n] + [(100, 101)]
    nodes = spark.createDataFrame([(i,) for i in [*range(n + 1), 100, 101, 200]], "node long")
    used = []
    levels = longest_levels(nodes, spark.createDataFrame(steps, "a long, b long"), used)
    assert {r["node"]: r["level"] for r in levels.collect()} == {**{i: i for i in range(n + 1)}, 100: 0, 101: 1, 200: 0}
    assert sum(used) == len(steps)


def brute_cycles(edges, most):
    out = set()

    def walk(path):
        for s, d in edges:
            if s == path[-1]:
                if d == path[0] and len(path) > 1:
                    out.add(tuple(path))
                elif d > path[0] and d not in path and len(path) < most:
                    walk([*path, d])

    for start in {s for s, _ in edges}:
        walk([start])
    return out


def test_short_cycles_equal_brute_force(spark):
    draw = random.Random(4)
    edges = {(draw.randrange(14), draw.randrange(14)) for _ in range(60)}
    edges = sorted((s, d) for s, d in edges if s != d)
    found = short_cycles(spark.createDataFrame(edges, "s long, d long"), 4).collect()
    assert len(found) == len({tuple(r["nodes"]) for r in found})
    assert {tuple(r["nodes"]) for r in found} == brute_cycles(edges, 4)


def test_hubs_make_few_wedges(spark):
    """A hub linked both ways with 3,000 files on a ring: wedges grow with the edges, not with the square."""
    n = 3000
    edges = [(0, i) for i in range(1, n + 1)] + [(i, 0) for i in range(1, n + 1)] + [(i, i % n + 1) for i in range(1, n + 1)]
    table = spark.createDataFrame(edges, "s long, d long")
    assert wedges(neighbour_pairs(table)).count() <= 2 * len(edges)
    assert short_cycles(table, 3).count() == n + n


def test_reach_counts_of_wide_words(spark):
    """Files over many words, a shortcut, and a diamond: counted once, at the first level."""
    graph = make(spark, [(f"f{i:04}", "hub") for i in range(300)] + [("top", "f0000"), ("top", "hub"), ("x", "top"), ("x", "f0001")])
    rows = {r["file"]: r for r in graph.impact_summary().collect()}
    assert (rows["hub"]["total_impacted"], rows["hub"]["direct"], rows["hub"]["cascade_depth"]) == (302, 301, 2)
    assert (rows["f0000"]["total_impacted"], rows["f0000"]["cascade_depth"]) == (2, 2)
    ask = spark.createDataFrame([("r", "hub"), ("r", "x")], "repo string, file string")
    assert {r["file"]: r["total_impacted"] for r in graph.check_safe(ask).collect()} == {"hub": 302, "x": 0}


def test_components_after_changes(spark):
    """Rings that split, merge and stay, files that come and go: as computed anew, and what stays isn't touched."""
    draw = random.Random(8)
    names = [f"n{i:02}" for i in range(40)]
    old = {(draw.choice(names), draw.choice(names)) for _ in range(70)} | {("q1", "q2"), ("q2", "q1")}
    old = {(s, d) for s, d in old if s != d}
    gone = {"n03", "n17"}
    new = {e for e in old if draw.random() > 0.2 or e[0][0] == "q"} | {(draw.choice(names), draw.choice([*names, "new"])) for _ in range(12)}
    new = {(s, d) for s, d in new if s != d and not gone & {s, d}}
    first, second = make(spark, sorted(old), names), make(spark, sorted(new), [n for n in names if n not in gone])
    diff = edge_diff(first.edges, second.edges)
    before = first.components()
    changed = {r["path"]: r["comp"] for r in changed_components(before, second.files, second.edges, diff).collect()}
    want = {r["path"]: r["comp"] for r in second.components().collect()}
    was = {r["path"]: r["comp"] for r in before.collect()}
    assert changed == {p: c for p, c in want.items() if was.get(p) != c} and changed
    assert "q1" not in changed and "q2" not in changed


def test_found_words_stay_in_place(spark, monkeypatch):
    """Large rounds look into every earlier one where it lies; many earlier ones are merged, none is lost or counted twice."""
    import random

    from pyspark.sql import functions as F

    from depgraph_spark.plans import reach

    laid, in_place = [], reach._in_place
    monkeypatch.setattr(reach, "_in_place", lambda words, n: laid.append(in_place(words, n)) or laid[-1])
    monkeypatch.setattr(reach, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(reach, "MAX_LAYERS", 3)
    draw = random.Random(7)
    links = {(draw.randrange(max(0, i - 9), i), i) for i in range(1, 40) for _ in range(2)}
    want = {}
    for start in {a for a, _ in links}:
        seen, ahead, depth = set(), {start}, 0
        while ahead := {b for a, b in links if a in ahead} - seen:
            seen, depth = seen | ahead, depth + 1
        want[start] = (len(seen), depth)
    assert max(depth for _, depth in want.values()) > 4
    steps = spark.createDataFrame(sorted(links), "a bigint, b bigint")
    own = reach.own_bits(spark.range(40).select(F.col("id").alias("node"), "id"))
    got = reach.reach_counts(steps, own, len(links)).collect()
    assert {r["node"]: (r["reached"], r["depth"]) for r in got} == want
    assert len(laid) > max(depth for _, depth in want.values()) and not any(df.is_cached for df in laid)
