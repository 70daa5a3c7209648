import random

from rxlake.llm import quotes as Q

A = "The quick brown fox jumps over it.\nSecond line of some words here."
B = "> The quick  brown fox jumps over it.\n> Second line of some words here.\n\nI agree with that."
C = "On Monday Ann wrote:\n> I agree with that.\n> > The quick brown fox jumps over it.\n> > Second line of some words here.\nMe too, friends."


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, body string").repartition(3)


def run(spark, rows):
    return {(r.conv_id, r.turn): r for r in Q.link(frame(spark, rows)).collect()}


def test_nested_quotes(spark):
    got = run(spark, [(1, 0, "user", A), (1, 1, "user", "unrelated"), (1, 2, "assistant", B), (1, 3, "user", C),
                      (2, 0, "user", "> second LINE of some words here.\nfrom elsewhere"), (3, 0, "user", "> nobody said this at all\nhm"),
                      (0, 0, "user", "> I agree with that.\nfirst of all, so not a reply"), (4, 0, "user", None), (4, 1, "user", ""),
                      (None, 1, "user", "> x\nalone"), (None, None, None, None)])
    p = {k: (r.parent_conv, r.parent_turn) for k, r in got.items()}
    assert p[1, 0] == (None, None) and p[1, 1] == (1, 0) and p[1, 2] == (1, 0) and p[1, 3] == (1, 2)
    assert p[2, 0] == (1, 0) and p[3, 0] == (None, None) and p[0, 0] == (None, None) and p[4, 1] == (4, 0)
    body = {k: r.body for k, r in got.items()}
    assert body[1, 2] == "I agree with that." and body[1, 3] == "Me too, friends." and body[2, 0] == "from elsewhere"
    assert body[1, 0] == A and body[4, 0] == body[4, 1] == "" and body[None, 1] == "alone"
    assert [got[1, t].n_quotes for t in range(4)] == [0, 0, 1, 2] and got[1, 3].max_level == 2
    assert {(r.thread_conv, r.thread_turn) for k, r in got.items() if k[0] in (1, 2)} == {(1, 0)}
    thread = sorted((r.position, r.depth, k) for k, r in got.items() if k[0] in (1, 2))
    assert [t[0] for t in thread] == [0, 1, 2, 3, 4] and [t[2] for t in thread] == [(1, 0), (1, 1), (1, 2), (2, 0), (1, 3)]
    assert got[None, None].thread_conv is None and got[None, None].body == ""


def test_random_threads_equal_brute_force(spark):
    rnd = random.Random(4)
    rows, parent = [], {}
    for c in range(12):
        for t in range(rnd.choice([1, 2, 9, 40])):
            key, text = (c, t), f"message {c} {t} with " + " ".join(rnd.choice("abcdefg") for _ in range(6))
            parent[key] = (c, t - 1) if t else None
            earlier = [r for r in rows if (r[0], r[1]) < key]
            if earlier and rnd.random() < .6:
                o = rnd.choice(earlier)
                own = [x for x in o[3].split("\n") if not x.startswith(">")]
                text = "\n".join("> " + x for x in own) + "\n" + text
                parent[key] = (o[0], o[1])
            rows.append((c, t, "user", text))
    rows += [(50, t, "user", "long chain of turns") for t in range(300)]
    parent |= {(50, t): (50, t - 1) if t else None for t in range(300)}
    depth, root = {}, {}
    for k in sorted(parent):
        p = parent[k]
        depth[k], root[k] = (depth[p] + 1, root[p]) if p else (0, k)
    got = run(spark, rows)
    assert {k: (r.parent_conv, r.parent_turn) if r.parent_conv is not None else None for k, r in got.items()} == parent
    assert {k: r.depth for k, r in got.items()} == depth and {k: (r.thread_conv, r.thread_turn) for k, r in got.items()} == root
    for top in set(root.values()):
        order = sorted((depth[k], k) for k in root if root[k] == top)
        assert [got[k].position for _, k in order] == list(range(len(order)))


def test_deeper_levels_are_linked(spark):
    inner = "> > The quick brown fox jumps over it.\n> > Second line of some words here.\n> nobody ever wrote this one\nhm"
    both = "> I agree with that.\n> > The quick brown fox jumps over it.\n> > Second line of some words here.\nyes"
    rows = [(1, 0, "user", A), (1, 1, "user", "something else"), (1, 2, "user", inner), (1, 3, "user", B), (1, 4, "user", both)]
    got = run(spark, rows)
    assert (got[1, 2].parent_turn, got[1, 2].linked_level) == (0, 2)        # only the inner quote is known
    assert (got[1, 4].parent_turn, got[1, 4].linked_level) == (3, 1)        # what is quoted directly, though it is shorter
    assert (got[1, 1].parent_turn, got[1, 1].linked_level) == (0, 0)
    src = Q.parse(frame(spark, rows).selectExpr("conv_id conv", "turn", "role", "text"), ["conv", "turn", "role"], "text")
    assert {(r.turn, r.level, r.p.turn) for r in Q.links(src).collect()} == {(2, 2, 0), (3, 1, 0), (4, 1, 3), (4, 2, 0)}


def test_latest_before_in_a_hot_key(spark):
    """One key with almost all rows: equal to a plain walk, and no task holds the key."""
    rnd = random.Random(9)
    rows = [(1 if rnd.random() < .95 else rnd.randrange(5), 7, rnd.randrange(4000), rnd.random() < .1) for _ in range(6000)]
    df = spark.createDataFrame(rows, "conv int, hash int, turn int, has boolean").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = Q.latest_before(df, ["conv", "hash"], "turn", "has", "near").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    events = {(c, t) for c, _, t, h in rows if h}
    want = sorted((c, t, h, max((e for k, e in events if k == c and e < t), default=-1)) for c, _, t, h in rows)
    assert sorted((r.conv, r.turn, r.has, -1 if r.near is None else r.near) for r in out) == want


def test_repeats_and_empty(spark):
    rows = [(1, 0, "user", A), (1, 0, "user", A), (1, 0, "user", "other text at the same place"), (1, 1, "user", B)]
    got = Q.link(frame(spark, rows)).collect()
    assert len(got) == 4 and {(r.parent_turn, r.position) for r in got if r.turn == 1} == {(0, 1)}
    assert Q.link(frame(spark, [])).count() == 0
    long = ">" * 50 + " x\n" + "> line of several plain words\n" * 20_000 + "end"
    assert [r.body for r in Q.link(frame(spark, [(1, 0, "user", long)])).collect()] == ["end"]
