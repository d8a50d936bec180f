"""Leiden communities and reports by level: quality, bounds, and a plain version of the packing."""

from __future__ import annotations

import json
import random

import pytest

from graphloom.operators import communities as CO
from graphloom.operators import leiden as LE
from graphloom.operators import reports as RE

EDGES = "src string, tgt string, weight double"


def ring(cliques=6, size=5):
    rows = [(f"c{k}_{i}", f"c{k}_{j}", 1.0) for k in range(cliques) for i in range(size) for j in range(i + 1, size)]
    return rows + [(f"c{k}_0", f"c{(k + 1) % cliques}_1", 1.0) for k in range(cliques)]


def planted(groups=4, size=12, seed=3):
    rng, n = random.Random(seed), groups * size
    return [(f"v{i:03d}", f"v{j:03d}", rng.choice([1.0, 2.0])) for i in range(n) for j in range(i + 1, n) if rng.random() < (0.5 if i // size == j // size else 0.05)]


def tree(n=60):
    return [(f"t{i:03d}", f"t{(i - 1) // 3:03d}", 1.0) for i in range(1, n)]


def brute_modularity(rows, member):
    m2 = 2 * sum(w for *_, w in rows)
    inside, k = 0.0, {}
    for a, b, w in rows:
        inside += 2 * w * (member[a] == member[b])
        k[member[a]] = k.get(member[a], 0) + w
        k[member[b]] = k.get(member[b], 0) + w
    return inside / m2 - sum(x * x for x in k.values()) / m2**2


def connected(rows, some):
    near = {x: set() for x in some}
    for a, b, _ in rows:
        if a in near and b in near:
            near[a].add(b)
            near[b].add(a)
    seen, todo = set(), [next(iter(some))]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += near[x]
    return seen == set(some)


@pytest.mark.parametrize("rows", [ring(), planted(), tree()], ids=["ring", "planted", "tree"])
def test_leiden_is_as_good_as_label_propagation(spark, rows):
    e = spark.createDataFrame([(b, a, w) for a, b, w in rows], EDGES)
    member = {r["node"]: r["cluster"] for r in LE.leiden(e).collect()}
    assert set(member) == {x for a, b, _ in rows for x in (a, b)}
    quality, n = LE.modularity(e, spark.createDataFrame(list(member.items()), "node string, cluster string")).first()
    assert abs(quality - brute_modularity(rows, member)) < 1e-6 and n == len(set(member.values()))
    plain = {r["node"]: r["label"] for r in CO.propagate_labels(e).collect()}
    assert quality >= brute_modularity(rows, plain) - 1e-9
    for c in set(member.values()):
        assert connected(rows, [x for x in member if member[x] == c])


def test_levels_end_within_the_bound(spark):
    rows = ring(3, 4) + tree(13) + [(f"s{i}", "hub", 1.0) for i in range(9)]
    got = [tuple(r) for r in LE.hierarchical_leiden(spark.createDataFrame(rows, EDGES), most=5, rounds=5).collect()]
    final = {}
    for node, _, cluster, _, last in got:
        if last:
            final.setdefault(cluster, []).append(node)
    nodes = {x for a, b, _ in rows for x in (a, b)}
    assert sorted(x for c in final.values() for x in c) == sorted(nodes) and max(map(len, final.values())) <= 5
    own = {(level, node): cluster for node, level, cluster, _, _ in got}
    assert {node for level, node in own if level == 0} == nodes
    assert all(parent == own[level - 1, node] for node, level, _, parent, _ in got if level)


def test_leiden_repeats_itself(spark):
    e = spark.createDataFrame(ring(3, 4), EDGES)
    assert sorted(map(tuple, LE.leiden(e).collect())) == sorted(map(tuple, LE.leiden(e.repartition(3)).collect()))


def test_modularity_of_no_edges_and_self_loops(spark):
    none = spark.createDataFrame([], EDGES)
    member = spark.createDataFrame([("a", "x")], "node string, cluster string")
    assert LE.modularity(none, member).first()["modularity"] is None
    assert LE.leiden(none).count() == 0
    loops = spark.createDataFrame([("a", "a", 1.0), ("a", "b", None)], EDGES)
    assert {r["node"] for r in LE.leiden(loops).collect()} == {"a", "b"}


# reports


class Judge:
    """A report in JSON for most clusters, plain text for one; the rating is the length of the description."""

    def complete(self, prompts):
        out = []
        for p in prompts:
            _, cluster, description = p.split("\t", 2)
            assert description.count("-----Entities-----") == 1
            out.append("no json" if cluster == "B1" else json.dumps({"title": f"On {cluster}", "summary": f"{len(description)} letters " * 3, "rating": float(len(description)), "findings": [{"summary": "s", "explanation": cluster}]}))
        return out


def plain_reports(levels, nodes, edges, chunks, budget):
    """The same, one cluster after another. levels: {level: {cluster: nodes}}."""
    count = lambda text: len((text or "").split())
    degree = {n: sum((a == n) + (b == n) for a, b, _ in edges) for n in nodes}
    shape = {c: len({k for n, k in chunks if n in own}) for level in levels.values() for c, own in level.items()}
    top = max(shape.values())
    quote = lambda x: '"' + str(x).replace('"', '""') + '"'
    done, asked = {}, 0

    def table(header, rows):
        return "\n".join([",".join(quote(h) for h in header)] + [",".join(map(quote, r)) for r in rows])

    def start(rows, key, most):
        out, used = [], 0
        for r in rows:
            used += count(r[key])
            if used > most:
                break
            out.append(r)
        return out

    for level in sorted(levels, reverse=True):
        new = {}
        for c, own in levels[level].items():
            inner_edges = sorted(((a, b, d) for a, b, d in edges if a in own or b in own), key=lambda e: (e[0] + e[1], e[0]))
            n = sorted(((i, x, nodes[x][0], nodes[x][1], degree[x]) for i, x in enumerate(sorted(own))), key=lambda r: (-r[4], r[0]))
            e = sorted(((i, a, b, d, degree[a] + degree[b]) for i, (a, b, d) in enumerate(inner_edges)), key=lambda r: (-r[4], r[0]))
            kept_n, kept_e, report = start(n, 3, budget // 2), start(e, 3, budget // 2), ""
            subs = [s for s, inside in levels.get(level + 1, {}).items() if inside <= own]
            if (len(kept_n) < len(n) or len(kept_e) < len(e)) and subs and done:
                ranked = sorted(subs, key=lambda s: (-done[s]["occurrence"], s))
                used = start([(s, done[s]["report_string"]) for s in ranked], 1, budget)
                if used:
                    report = table(RE.HEADERS["Reports"], [(i, r, done[s]["rating"], done[s]["occurrence"]) for i, (s, r) in enumerate(used)])
                    held = set().union(*(levels[level + 1][s] for s, _ in used))
                    held_e = {(a, b) for a, b, _ in edges if a in held or b in held}
                    room = (budget - count(report)) // 2
                    kept_n = start([r for r in n if r[1] not in held] + [r for r in n if r[1] in held], 3, room)
                    kept_e = start([r for r in e if (r[1], r[2]) not in held_e] + [r for r in e if (r[1], r[2]) in held_e], 3, room)
            parts = {"Reports": report, "Entities": table(RE.HEADERS["Entities"], kept_n) if kept_n else "", "Relationships": table(RE.HEADERS["Relationships"], kept_e) if kept_e else ""}
            text = "\n".join(f"-----{k}-----\n```csv\n{v}\n```" for k, v in parts.items())
            answer = Judge().complete([f"report\t{c}\t{text}"])[0]
            asked += 1
            try:
                j = json.loads(answer)
            except ValueError:
                j = {"title": "Community Report", "summary": answer, "rating": -1.0, "findings": []}
            full = "\n\n".join([f"# {j['title']}", j["summary"], "\n\n".join(f"## {f['summary']}\n\n{f['explanation']}" for f in j["findings"])])
            new[c] = {"rating": j["rating"], "report_string": full, "occurrence": round(shape[c] / top, 6), "title": j["title"], "n_subs": len(subs)}
        done.update(new)
    return done, asked


@pytest.mark.parametrize("budget", [1000, 60, 24])
def test_reports_equal_a_plain_version_over_three_levels(spark, budget):
    rng = random.Random(5)
    names = [f"n{i:02d}" for i in range(16)]
    nodes = {x: (rng.choice(["kind", "sort"]), " ".join(["word"] * rng.randint(1, 5)) + f' "{x}"') for x in names}
    edges = [(a, b, " ".join(["tie"] * rng.randint(1, 4))) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < 0.2]
    chunks = [(x, k) for x in names for k in range(12) if rng.random() < 0.3]
    levels = {0: {"A": set(names)}, 1: {f"B{k}": set(names[8 * k : 8 * k + 8]) for k in range(2)}, 2: {f"C{k}": set(names[4 * k : 4 * k + 4]) for k in range(4)}}
    member = spark.createDataFrame([(x, level, c) for level, cs in levels.items() for c, own in cs.items() for x in own], "node string, level int, cluster string")
    got = RE.reports_by_level(
        member, spark.createDataFrame([(x, *t) for x, t in nodes.items()], "entity_name string, entity_type string, description string"),
        spark.createDataFrame([(a, b, d, 1.0) for a, b, d in edges], "src string, tgt string, description string, weight double"),
        spark.createDataFrame(chunks, "entity_name string, chunk_id int"), Judge(), budget).collect()
    want, asked = plain_reports(levels, nodes, edges, chunks, budget)
    assert len(got) == asked == 7
    for r in got:
        own = want[r["cluster"]]
        assert (r["title"], r["rating"], r["report_string"], r["n_subs"]) == (own["title"], own["rating"], own["report_string"], own["n_subs"])
        assert abs(r["occurrence"] - own["occurrence"]) < 1e-6
