"""Benchmark items shorter than the window."""

from catalume.llm import decontam


def test_whole_short_items_are_cut_from_five_words_on(frame, spark):
    items = [(n, " ".join(f"k{n}x{j}" for j in range(n))) for n in (1, 4, 5, 7, 9, 12)]
    body = " ".join(f"w{i}" for i in range(40))
    docs = [(n, f"{body} {t}. {body}") for n, t in items] + [(20, f"{body} k9x0 k9x1 k9x2 k9x3 k9x4 k9x5 {body}"), (21, " ".join(f"k12x{j}" for j in range(9)) + " " + body)]
    got = {r["doc_id"]: r["text"] for r in decontam.decontaminate(frame(docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for n, t in docs:
        assert got[n] == (f"{body} . {body}" if n in (5, 7, 9, 12) else t), n
