"""Proximity matches of decontamination, whichever terms of a window are missing."""

from moraine.llm import decontaminate

ITEM = "one two three four five six seven eight nine ten"


def test_any_term_may_be_missing(spark):
    """Each document misses one or two terms of the window; of some the missing one is the rarest, or stands in no text."""
    terms = ITEM.split()
    without = lambda *gone: " ".join("zz" if i in gone else t for i, t in enumerate(terms))
    rows = [(i, f"a b {without(i)} c d") for i in range(10)] + [(10 + i, without(i, (i + 3) % 10)) for i in range(10)] + [(20, without(1, 4, 7)), (21, ITEM), (22, None)]
    # "ten" is the rarest by far but for one text
    docs = spark.createDataFrame([(i, t) for i, t in rows] + [(100, " ".join(terms[:9]) + " x " * 30)] , "doc_id bigint, text string")
    for item in (ITEM, ITEM.replace("ten", "nowhere")):
        items = spark.createDataFrame([(7, item)], "item_id bigint, text string")
        got = {r.id: (r["items"], r["near_items"]) for r in decontaminate.contamination(docs, items, near=0.8).collect()}
        for i, text in [(r.doc_id, r.text) for r in docs.collect()]:
            words = (text or "").split()
            exact = ["7"] if item in (text or "") else []
            near = ["7"] if not exact and len(set(item.split()) & set(words)) >= 8 else []
            assert got[i] == (exact, near), (i, text)
    plain = decontaminate.contamination(docs, items)
    assert plain.columns == ["id", "n_words", "n_hit", "items"]
