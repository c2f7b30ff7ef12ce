"""Further places of live values: without a digit, at a sentence's end, joined to other text."""

import hashlib

from groundspark.llm import secrets


def test_live_values_are_found_wherever_they_stand(spark):
    value, mixed = "correcthorsebattery", "aB3dE-fgh/9XyZ.q1w2"
    table = [
        (1, f"password={value}", "s0"),
        (2, f"it was {value}.", "s1"),
        (3, f"auth={value} and path/{value}/x-{value}", "s2"),
        (4, f"x{value} {value}y un{value}", "s3"),
        (5, f"token: {mixed}", "s0"),
        (6, f"see etc/{mixed}.", "s1"),
        (7, "secret=copiedcopiedcopied", "s0"),
        (8, "secret=copiedcopiedcopied", "s1"),
        (9, "copiedcopiedcopied.", "s2"),
        (10, f"password={value}", "s0"),
    ]
    got = {r.doc_id: r.spans for r in secrets.scan(spark.createDataFrame(table, "doc_id long, text string, source string")).select("doc_id", secrets.written(secrets.F.col("spans")).alias("spans")).collect()}

    def places(i, what):
        text, found, at = table[i - 1][1], [], -1
        while (at := text.find(what, at + 1)) >= 0:
            found.append(f"owned:{at}:{at + len(what)}")
        return ",".join(found)

    assert got[2] == places(2, value) and got[3] == places(3, value) and got[3].count("owned") == 3
    assert got[4] == "" and got[6] == places(6, mixed) and got[9] == ""
    assert got[1].startswith("assign:") and "owned" not in got[1] + got[10]


def spans_of(spark, table):
    docs = spark.createDataFrame(table, "doc_id long, text string, source string").repartition(4)
    return {r.doc_id: r.spans for r in secrets.scan(docs).select("doc_id", secrets.written(secrets.F.col("spans")).alias("spans")).collect()}


def test_values_that_share_words_meet_only_their_own_places(spark):
    """All pairs by a shared word would be ten thousand million."""
    n = 100_000
    value = lambda i: "production-{0}-{1}".format(*(hashlib.md5(f"{i}/{k}".encode()).hexdigest()[:9] for k in range(2)))
    got = spans_of(spark, [(i, f"token: {value(i)}", f"s{i % 9}") for i in range(n)] + [(n + i, f"see env/{value(i)}/now", "s0") for i in range(0, n, 10)])
    assert all(got[i].startswith("assign:0:") and "owned" not in got[i] for i in range(n))
    assert all(got[n + i] == f"owned:8:{8 + len(value(i))}" for i in range(0, n, 10))


def test_a_text_of_ten_million_characters(spark):
    """Hundreds of thousands of identifiers, and one run of paths that never ends, with a live value far inside each."""
    value = "kX9/vQ2zR7-mT4w"
    names = [f"identifier_{i:07d}" for i in range(400_000)]
    names[350_000] = value
    words, path = " ".join(names), "/".join(f"part{i:06d}" for i in range(300_000)) + f"/{value}"
    got = spans_of(spark, [(1, f"api_key={value}", "s0"), (2, words, "s1"), (3, path, "s1")])
    assert got[2] == f"owned:{words.index(value)}:{words.index(value) + len(value)}"
    assert got[3] == f"owned:{len(path) - len(value)}:{len(path)}"


def test_many_secrets_in_one_text(spark):
    text = "\n".join(f"token: v{i:06d}kQ-zR7mT4w" for i in range(50_000))
    got = spans_of(spark, [(1, text, "s0")])[1].split(",")
    at, step = 0, len("token: v000000kQ-zR7mT4w")
    assert got == [f"assign:{at + i * (step + 1)}:{at + i * (step + 1) + step}" for i in range(50_000)]


def test_joints_around_values_and_places_that_overlap(spark):
    value, turns = "==aB3dE9-fGh1Kl==", "a1b2c3-d4e5-a1b2c3"
    table = [(1, f"token: x{value}", "s0"), (2, f"token: {turns}", "s0"), (3, f"q{'x' + value}y xx{value} .x{value}=", "s1"), (4, "-".join(["a1b2c3-d4e5"] * 5) + "-a1b2c3", "s1")]
    got = spans_of(spark, table)
    text = table[2][1]
    assert got[3] == f"owned:{text.rindex('x' + value)}:{text.rindex('x' + value) + 1 + len(value)}"
    assert got[4] == ",".join(f"owned:{24 * i}:{24 * i + len(turns)}" for i in range(3))
