"""One inconsistent value takes only its own windows with it."""

from linklens.llm import op1_template_join as T


def words(low, high):
    return " ".join(f"{chr(97 + k // 26)}{chr(97 + k % 26)}x" for k in range(low, high))


def text(a, b, c=""):
    return f"{words(0, 14)} {a} {words(14, 34)} {b} {words(34, 54)}{c}"


def test_edited_values(spark):
    long = words(100, 108).join(["", " {} "]) + words(108, 116) + " {} " + words(116, 124) + " {} " + words(124, 150)
    items = [(1, text(7, 7)), (2, text(3, 5, " end of it")), (3, long.format(6, 6, 6))]
    docs = [(1, text(7, 8)), (2, text(4, 4, " end of it")), (3, long.format(9, 9, 2)), (4, "x " + text(7, 7)), (5, text(9, 9))]
    docs += [(6, "a " + " ".join(str(k) for k in range(60)))]
    got = {(r.doc_id, r.item_id): (r.n_windows, r.item_windows, r.kind) for r in T.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got[1, 1] == (47, 52, "verbatim")  # the windows of the edited 8 are missing
    assert got[2, 2] == (45, 55, "verbatim")  # 4 stands neither for 3 nor for 5
    assert got[3, 3] == (44, 49, "reparameterised")  # 9 stands for 6, 2 doesn't
    assert got[4, 1] == (52, 52, "verbatim") and got[5, 1] == (52, 52, "reparameterised")
    assert not any(d == 6 for d, _ in got)
    left = T.drop_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert [r.doc_id for r in left.collect()] == [6]
