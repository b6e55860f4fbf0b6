from __future__ import annotations

import pandas as pd

from tessella.functions import udfs


def test_functions(spark):
    spark.range(4).createOrReplaceTempView("four")

    def double(x: pd.Series) -> pd.Series:
        return x * 2

    def spread(x: pd.Series) -> float:
        return float(x.max() - x.min())

    class Count:
        def eval(self, n: int):
            for i in range(n):
                yield (i,)

    udfs.scalar(spark, "double_it", double, "bigint")
    udfs.scalar_rows(spark, "clamp", lambda x, hi: min(x, hi), "bigint")
    udfs.aggregate(spark, "spread", spread, "double")
    udfs.table(spark, "count_to", Count, "i int")
    assert [r[0] for r in spark.sql("SELECT double_it(id) FROM four ORDER BY id").collect()] == [0, 2, 4, 6]
    assert [r[0] for r in spark.sql("SELECT clamp(id, 2L) FROM four ORDER BY id").collect()] == [0, 1, 2, 2]
    assert spark.sql("SELECT spread(id) FROM four").head()[0] == 3.0
    assert spark.sql("SELECT count(*) FROM count_to(5)").head()[0] == 5
