"""Documents that pass the quality rules go on without their failing lines."""

import corpus_pipeline


def test_failing_lines_are_gone_after_the_stage(spark):
    prose = ["The river runs past the old mill and the children play near the water. " * 2,
             "Later in the day a cart brings flour to the town, and people talk about the weather before supper.",
             "", "Nobody in the valley remembers when the bridge was built, but every family has a tale about the flood."]
    text = "\n".join([prose[0], "Home | About | Contact", *prose[1:], "Click here to sign up"])
    rows = [(1, text, "en", len(text)), (2, "\n".join(prose), "en", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_chars bigint")
    left = corpus_pipeline.quality(spark, docs, "")
    clean = "\n".join(prose)
    assert left.dtypes == docs.dtypes
    assert sorted(map(tuple, left.collect())) == [(1, clean, "en", len(clean)), (2, clean, "en", len(clean))]
