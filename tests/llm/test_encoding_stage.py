"""The last stage on tables that have columns of its own names."""

from pyspark.sql import functions as F

import corpus_pipeline

STAGE = dict(corpus_pipeline.STAGES)["bpe_encoding"]


def test_columns_of_the_results_names_are_moved(spark, odd, none):
    for docs in (odd, none):
        clashing = docs.withColumns({"ids": F.lit("own"), "N_tokens": F.lit(-1), "_ids": F.lit(2.5)})
        out = STAGE(spark, clashing, "")
        assert out.columns == [*docs.columns, "__ids", "_N_tokens", "_ids", "ids", "n_tokens"]
        assert out.count() == docs.count()
        assert out.where("__ids != 'own' or _N_tokens != -1 or _ids != 2.5 or n_tokens != size(ids)").count() == 0
        assert STAGE(spark, docs, "").columns == [*docs.columns, "ids", "n_tokens"]
