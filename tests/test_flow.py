"""Flow-sensitive sets against a plain solver that keeps memory at every statement, and against runs of random programs."""

import random
from collections import defaultdict

from factloom.operators import flow
from factloom.plans import catalog
from factloom.sources import fixtures

STATEMENTS, FLOW = "at long, block long, ord int, op string, dst long, src long", "block long, next long"


def included(statements):
    pts = defaultdict(set)
    while True:
        before = sum(map(len, pts.values()))
        for *_, op, d, s in statements:
            if op == "ADDR":
                pts[d].add(s)
            elif op == "COPY":
                pts[d] |= pts[s]
            elif op == "LOAD":
                for o in list(pts[s]):
                    pts[d] |= pts[o]
            else:
                for o in list(pts[d]):
                    pts[o] |= pts[s]
        if before == sum(map(len, pts.values())):
            return pts


def solved(statements, edges, singles):
    """Memory as a dictionary after each statement, all statements visited until nothing changes."""
    aux, blocks, before, after = included(statements), defaultdict(list), {}, defaultdict(lambda: defaultdict(set))
    for s in sorted(statements, key=lambda s: (s[2], s[0])):
        blocks[s[1]].append(s)
    for b in {s[1] for s in statements} | {x for e in edges for x in e}:
        before[("in", b)] = [p for p, n in edges if n == b]
        at = ("in", b)
        for s in blocks[b]:
            before[s[0]], at = [at], s[0]
        before[("end", b)] = [at]
    for b, preds in [(k, v) for k, v in before.items() if isinstance(k, tuple) and k[0] == "in"]:
        before[b] = [("end", p) for p in preds]
    of, pts = {s[0]: s for s in statements}, defaultdict(set)
    while True:
        n = sum(map(len, pts.values())) + sum(len(x) for m in after.values() for x in m.values())
        for at, preds in before.items():
            mem = defaultdict(set)
            for p in preds:
                for o, held in list(after[p].items()):
                    mem[o] |= held
            if at in of:
                *_, op, d, s = of[at]
                if op == "ADDR":
                    pts[d].add(s)
                elif op == "COPY":
                    pts[d] |= pts[s]
                elif op == "LOAD":
                    for o in list(pts[s]):
                        pts[d] |= mem[o]
                else:
                    for o in aux[d]:
                        passes = any(x != o or x not in singles for x in pts[d])
                        mem[o] = (set(pts[s]) if o in pts[d] else set()) | (mem[o] if passes else set())
            for o, held in mem.items():
                after[at][o] |= held
        if n == sum(map(len, pts.values())) + sum(len(x) for m in after.values() for x in m.values()):
            break
    want = {(v, None, None, o) for v, s in pts.items() for o in s}
    return want | {(None, s[0], o, x) for s in statements if s[3] == "STORE" for o in aux[s[4]] for x in after[s[0]][o]}


def program(rng, n_blocks, n_vars, n_sites, each):
    statements, at = [], 0
    for b in range(n_blocks):
        for i in range(rng.randrange(each + 1)):
            op = rng.choices(["ADDR", "COPY", "LOAD", "STORE"], [3, 1, 3, 4])[0]
            statements.append((at, b, i // 2, op, rng.randrange(n_vars), -1 - rng.randrange(n_sites) if op == "ADDR" else rng.randrange(n_vars)))
            at += 1
    edges = [(b, b + 1) for b in range(n_blocks - 1)] + [(rng.randrange(n_blocks), rng.randrange(n_blocks)) for _ in range(n_blocks // 2)]
    return statements, edges, {-1 - k for k in range(n_sites) if k % 3}


def run(spark, statements, edges, singles):
    got = flow.solve(spark.createDataFrame(statements, STATEMENTS), spark.createDataFrame(edges, FLOW), spark.createDataFrame([(s,) for s in singles], "site long"))
    rows = [tuple(r) for r in got.select("ptr", "at", "obj", "site").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_random_programs(spark):
    rng = random.Random(11)
    for shape in ((6, 8, 4, 4), (14, 25, 6, 5)):
        statements, edges, singles = program(rng, *shape)
        want = solved(statements, edges, singles)
        noise = [(9000, 0, 1, "COPY", None, 1), (9001, None, 1, "COPY", 0, 1), statements[0]]
        assert run(spark, statements + noise, edges + [(None, 1), (2, None), edges[0]], singles) == want
        # walks through the program see nothing else
        sets = defaultdict(set)
        for v, _, _, o in (r for r in want if r[0] is not None):
            sets[v].add(o)
        for _ in range(300):
            env, mem, b, n = {}, {}, rng.randrange(shape[0]), 0
            for _ in range(12):
                stopped = False
                for _, _, _, op, d, s in sorted((x for x in statements if x[1] == b), key=lambda x: (x[2], x[0])):
                    n += 1
                    if op == "ADDR":
                        env[d] = (s, 0 if s in singles else n)
                    elif op == "STORE" and env.get(d) is not None:
                        mem[env[d]] = env.get(s)
                    elif op == "COPY":
                        env[d] = env.get(s)
                    elif op == "LOAD" and env.get(s) is not None:
                        env[d] = mem.get(env[s])
                    else:
                        stopped = True
                        break
                    assert op == "STORE" or env[d] is None or env[d][0] in sets[d]
                follow = [n_ for p, n_ in edges if p == b]
                if stopped or not follow:
                    break
                b = rng.choice(follow)


def test_a_store_overwrites_one_cell_on_one_way(spark):
    # 1 = &a, 2 = &b, 3 = &c; *1 = 2; then on one way *1 = 3; 4 = *1 on that way, 5 = *1 where the ways meet
    statements = [(1, 0, 1, "ADDR", 1, -1), (2, 0, 2, "ADDR", 2, -2), (3, 0, 3, "ADDR", 3, -3), (4, 0, 4, "STORE", 1, 2),
                  (5, 1, 1, "STORE", 1, 3), (6, 1, 2, "LOAD", 4, 1), (7, 3, 1, "LOAD", 5, 1)]
    edges = [(0, 1), (0, 2), (1, 3), (2, 3)]
    of = lambda rows, v: {r[3] for r in rows if r[0] == v}
    got = run(spark, statements, edges, {-1})
    assert of(got, 4) == {-3} and of(got, 5) == {-2, -3}
    got = run(spark, statements, edges, set())  # several cells: the old contents may still be there
    assert of(got, 4) == {-2, -3}


def test_empty_program(spark):
    assert run(spark, [], [], set()) == set()


def test_registered_query(spark, sf_dir):
    """Every line item of the smallest tables, unit by unit."""
    rows = [tuple(r) for r in fixtures.flow_statements(spark, sf_dir).select("at", "block", "ord", "op", "dst", "src").collect()]
    edges, singles = [tuple(r) for r in fixtures.flow_edges(spark, sf_dir).select("block", "next").collect()], {r[0] for r in fixtures.flow_singles(spark, sf_dir).collect()}
    want = set()
    for unit in {r[1] // fixtures.FLOW_UNIT for r in rows}:
        inside = lambda b: b // fixtures.FLOW_UNIT == unit  # noqa: B023, E731
        assert all(inside(a) == inside(b) for a, b in edges)
        want |= solved([r for r in rows if inside(r[1])], [e for e in edges if inside(e[0])], singles)
    got = [tuple(r) for r in catalog.q_pts_flow(spark, sf_dir).select("ptr", "at", "obj", "site").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert len({r for r in got if r[0] is not None}) < sum(len(s) for v, s in included(rows).items() if v >= 0)
