"""t_fuzzy_pairs against all pairs of titles of one language and first word."""

import difflib
import random
from itertools import combinations

from groundspark.functions import text
from groundspark.operators import linkage
from groundspark.plans.tables import t_fuzzy_pairs


def test_pairs_are_those_of_brute_force(spark, tmp_path):
    rng = random.Random(4)
    titles = ["internationalisation", "internationalisation handbook", "internationalisation handbooks", "grounding methods in plants", "grounding method in plants", "grounding methods in plant", "other methods in plants"]
    for _ in range(40):
        words = [rng.choice(["grounding", "plant"])] + ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 7))]
        titles.append(" ".join(words))
        for _ in range(3):
            at = rng.randrange(len(words))
            titles.append(" ".join(w + rng.choice("abcd") if k == at and k else w for k, w in enumerate(words)))
    titles = list(dict.fromkeys(titles))
    rows = [(i, f"{t}\nbody", "en" if i % 9 else "de") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for (i, x, lang), (j, y, other) in combinations([(i, t.split("\n")[0], z) for i, t, z in rows], 2):
        if lang == other and x.split()[0] == y.split()[0]:
            ratio = difflib.SequenceMatcher(None, x, y).ratio()
            if ratio >= 0.93:  # asked before rounding
                want[(i, j)] = round(ratio, 4)
    assert len(want) > 30
    got = t_fuzzy_pairs(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r.a, r.b): r.ratio for r in got} == want


def test_what_is_ruled_out_is_not_alike():
    rng = random.Random(8)
    for _ in range(300):
        a = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 40)))
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 2)] = rng.choice(["", "a", "xy"])
        b = "".join(b)
        matched = sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        assert matched <= text.most_matched(a, b)


def test_few_pairs_of_a_first_word_are_aligned(spark, monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 6))) for _ in range(80)]
    titles = list({" ".join(["plant", *rng.choices(words, k=12)])[:60].strip() for _ in range(120)})
    titles += [f"{t}s" for t in titles[:10]]
    assert sum(2 * text.most_matched(x, y) >= 0.93 * (len(x) + len(y)) for x, y in combinations(titles, 2)) < 30
    rows = spark.createDataFrame([("plant", i, t) for i, t in enumerate(titles)], "word string, id long, title string")
    monkeypatch.setattr(linkage, "DEALT", 7)  # many parts
    got = [(r.a, r.b) for r in linkage.alike_titles(rows, ["word"], 0.93).collect()]
    want = {(i, j) for (i, x), (j, y) in combinations(enumerate(titles), 2) if difflib.SequenceMatcher(None, x, y).ratio() >= 0.93}
    assert len(got) == len(want) >= 10 and set(got) == want
