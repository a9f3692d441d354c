"""The golden concordance: six lines around "and", with a metadata attribute g."""

from kwicloom.concordance import Concordance

LINES = [("the cat", "a dog", "x"), ("the dog", "a cat", "x"), ("A cat", "the dog", "y"), ("one bird", "a dog", "y"), ("two cats", "the fox", "y"), ("the cat", "a dog", "z")]


def golden(spark) -> Concordance:
    tokens = [(i, k, w) for i, (left, right, _) in enumerate(LINES) for k, w in enumerate([*left.split(), "and", *right.split()])]
    return Concordance(
        spark.createDataFrame([(i, g) for i, (_, _, g) in enumerate(LINES)], "line_id long, g string"),
        spark.createDataFrame(tokens, "line_id long, id_in_line int, word string"),
        spark.createDataFrame([(i, 2, 2, 0) for i in range(len(LINES))], "line_id long, match_start long, match_end long, slot int"),
    )
