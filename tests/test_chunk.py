from sievelake.operators import chunk


def test_short_and_blank():
    assert chunk.chunks(None) == chunk.chunks(" \n") == []
    assert chunk.chunks("# T\n\ntext") == ["# T\n\ntext"]


def test_sections_are_packed():
    a, b, c = (f"## H{i}\n\n" + "word " * 20 for i in range(3))
    got = chunk.chunks("\n".join((a, b, c)), budget=60)
    assert got == [a.strip() + "\n\n" + b.strip(), c.strip()]


def test_large_sections_repeat_their_header_and_lose_no_word():
    body = "\n\n".join(" ".join(f"w{i}-{j}" for j in range(30)) for i in range(20)) + "\n\n" + "long " * 400
    got = chunk.chunks(f"## Head\n{body}", budget=100)
    assert all(c.startswith("## Head\n") and chunk.tokens(c) <= 105 for c in got)  # sizes of parts are rounded down before they add up
    assert " ".join(c.removeprefix("## Head\n") for c in got).split() == body.split()


def test_overlap_is_the_tail_of_the_chunk_before():
    text = "\n".join(f"## H{i}\n\n" + f"word{i} " * 30 for i in range(4))
    plain, lapped = chunk.chunks(text, 70), chunk.chunks(text, 70, 10)
    assert lapped[0] == plain[0]
    for before, one, with_tail in zip(plain, plain[1:], lapped[1:]):
        end = with_tail[: -len(one) - 2]
        assert before.endswith(end) and 0 < len(end) <= 40


def test_header_path():
    assert chunk.header_path("# A\n## B\n### C\n## D\n#### E") == ["A", "D", "E"]
    assert chunk.tokens("日本語") == 2


def test_rows(spark):
    df = spark.createDataFrame([(1, "## A\n\nxxxx\n## B\n\nyyyy"), (2, None)], "id int, md string")
    got = chunk.chunked(df, "md", ["id"], budget=3).collect()
    assert [(x["id"], x["chunk_index"], x["total_chunks"], x["header_path"]) for x in got] == [(1, 0, 2, ["A"]), (1, 1, 2, ["B"])]
