"""Every language and every context of the training rows is in the model."""

from itertools import islice, permutations

from groundspark.llm import langid


def test_no_language_and_no_context_is_left_out(spark):
    names = [f"l{k:03d}" for k in range(90)]
    alphabets = list(islice(permutations("abcdefghij", 6), 0, 90 * 1000, 1000))
    texts = {name: " ".join("".join(a[i : i + 3]) for i in range(4)) for name, a in zip(names, alphabets, strict=True)}
    texts["l005"] = "ただ一つの小さい言語"  # beside one with most rows
    most = "".join(chr(0x4E00 + 7 * k) for k in range(2900))
    train = [(name, t) for name, t in texts.items()] + [("l000", most)] * 20
    model = langid.train(spark.createDataFrame(train, "lang string, text string"))
    assert model.langs == names
    assert len(set(texts.values())) == len(texts)
    asked = spark.createDataFrame([(k, t, True) for k, t in enumerate(texts.values())], "doc_id long, text string, held_out boolean")
    got = {r.doc_id: r.lang_pred for r in langid.predict(asked, model).collect()}
    assert sum(got[k] == name for k, name in enumerate(texts) if k) == len(texts) - 1
    held = {bytes(g.to_bytes(4, "big")) for g in map(int, model._load("grams-3"))}
    raw = langid.PAD + most.encode()
    assert {raw[i : i + 4] for i in range(len(raw) - 3)} <= held
