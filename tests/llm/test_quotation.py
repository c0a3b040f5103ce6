import random
import time

from quirekit.llm.quotation import linked_conversations, reply_ordered

ROWS = [
    (1, 0, "user", "First point.\nSecond point.\n\nThird  Point."),
    (1, 1, "assistant", "On Monday, A wrote:\n> first point.\n> second point.\nI agree."),
    (1, 2, "user", ">> third point.\n> I agree.\n\nGood."),
    (1, 3, "user", "> never said\nWhat?"),
    (2, 0, "user", "> I agree.\nHello"),
    (2, 1, None, None),
    (None, 1, "user", "> First point."),
    (1, 3, "user", "> never said\nWhat?"),
]


def test_links_levels_nulls_and_repeats(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "conv_id long, turn int, role string, text string, depth string")
    got = sorted((r.conv_id or 0, r.turn, r.own_text, r.n_quotes, r.n_linked, r.parent_turn, r.root_turn, r.depth) for r in linked_conversations(df).collect())
    assert got == [
        (0, 1, "", 1, 0, None, 1, 0),
        (1, 0, ROWS[0][3], 0, 0, None, 0, 0),
        (1, 1, "I agree.", 1, 3, 0, 0, 1),
        (1, 2, "Good.", 2, 2, 1, 0, 2),
        (1, 3, "What?", 1, 0, None, 3, 0),
        (1, 3, "What?", 1, 0, None, 3, 0),
        (2, 0, "Hello", 1, 0, None, 0, 0),
        (2, 1, "", 0, 0, None, 1, 0),
    ]


def test_long_reply_chain_and_empty_table(spark):
    rows = [(7, t, "user", f"> said {t - 1}\nsaid {t}") for t in range(20)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {r.turn: (r.root_turn, r.depth) for r in linked_conversations(df).collect()} == {t: (0, t) for t in range(20)}
    assert linked_conversations(df.limit(0)).count() == 0


def test_quotes_of_other_conversations_are_linked(spark):
    rows = [
        *ROWS,
        (3, 0, "user", "> Second point.\nHow?"),
        (3, 1, "user", "second point."),
        (4, 0, "user", "> How?\n> nowhere said\nx"),
        (4, 1, "user", "How?\n\n>> x\n\n> first point."),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {(r.conv_id, r.turn): (r.n_linked, r.parent_turn, r.n_elsewhere, r.other_conv_id, r.other_turn) for r in linked_conversations(df).collect()}
    assert {k: v for k, v in got.items() if v[0] or v[2]} == {
        (1, 1): (3, 0, 0, None, None),
        (1, 2): (2, 1, 0, None, None),
        (2, 0): (0, None, 1, 1, 1),
        (3, 0): (0, None, 1, 1, 0),
        (4, 0): (0, None, 1, 3, 0),
        (4, 1): (1, 0, 1, 1, 0),
    }


def brute(rows):
    """Links, roots and order found line by line in Python, for plain quotes without attributions."""
    def units(text):
        out, run = [], []

        def close():
            if run:
                level, norms = run[0][0], [n for _, n in run]
                out.extend((level, n) for n in ([" ".join(norms), *norms] if len(norms) > 1 else norms))
                run.clear()

        for line in (text or "").split("\n"):
            body = line.lstrip("> ") if line.startswith(">") else line
            level = line[: len(line) - len(body)].count(">")
            norm = " ".join(body.lower().split())
            if not norm or (run and run[0][0] != level):
                close()
            if norm:
                run.append((level, norm))
        close()
        return out

    said = {}
    for conv, turn, text in rows:
        for level, n in units(text):
            if level == 0:
                said[conv, n] = min(turn, said.get((conv, n), turn))
    parent = {}
    for conv, turn, text in rows:
        hits = [(level, -said[conv, n]) for level, n in units(text) if level and said.get((conv, n), turn) < turn]
        parent[conv, turn] = -min(hits)[1] if hits else None

    def root(conv, turn):
        while parent[conv, turn] is not None:
            turn = parent[conv, turn]
        return turn

    order = sorted((conv, root(conv, turn), turn) for conv, turn, _ in rows)
    firsts = {}
    for i, (conv, _, _) in enumerate(order):
        firsts.setdefault(conv, i)
    return {(conv, turn): (parent[conv, turn], r, i - firsts[conv]) for i, (conv, r, turn) in enumerate(order)}


def test_generated_threads_equal_brute_force_and_long_texts_end_soon(spark):
    r = random.Random(11)
    rows = []
    for conv in range(6):
        stated = []
        for turn in range(r.choice((3, 40, 150))):
            quotes = [f"{'>' * r.randrange(1, 4)} {r.choice(stated)}" for _ in range(r.randrange(3)) if stated]
            own = [f"Line {r.randrange(400)} of {conv % 3}" for _ in range(r.randrange(1, 4))]
            stated += own
            rows.append((conv, turn, "\n".join([*quotes, "", *own])))
    long = [f"word {i} and more" for i in range(2000)]
    rows += [(50, 0, "\n".join(long)), (50, 1, "\n".join(f"> {x}" for x in long) + "\nyes"), (50, 2, "\n".join(x for i in range(0, 2000, 2) for x in (f"> {long[i]}", "fine")))]
    df = spark.createDataFrame([(c, t, "user", x, 7) for c, t, x in rows], "conv_id long, turn long, role string, text string, position int").repartition(5)
    start = time.time()
    got = reply_ordered(df).collect()
    assert time.time() - start < 60
    assert {(x.conv_id, x.turn): (x.parent_turn, x.root_turn, x.position) for x in got} == brute(rows)
    assert "".join(x.formatted for x in sorted((x for x in got if x.conv_id == 50), key=lambda x: x.position)).startswith("<|im_start|>user\nword 0 and more\n")


def test_reply_order_of_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn int, role string, text string")
    got = reply_ordered(df)
    assert sorted((r.conv_id or 0, r.position) for r in got.collect()) == [(0, 0), (1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (2, 0), (2, 1)]
    assert [r.quoted[0].passage for r in got.where("turn = 3").collect()] == ["never said"] * 2
    assert reply_ordered(df.limit(0)).count() == 0
