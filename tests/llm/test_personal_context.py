"""Personal data in lists and assignments, whose context holds other matches."""

from tallygrid.llm import pii


def spans(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r.spans for r in pii.digest(frame).orderBy("doc_id").collect()]


def span(kind, text, part):
    return f"{kind}:{text.index(part)}:{text.index(part) + len(part)}"


def test_context_goes_beyond_neighbouring_matches(spark):
    numbers = "SSN 123-45-6789 and 234-56-7890."
    value = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    key = f"AWS_SECRET_ACCESS_KEY={value}"
    after = "000-12-3456, 234-56-7890 and 000-11-2222 (tax id)"
    far = "SSN 123-45-6789" + " " * 60 + "234-56-7890."
    assert spans(spark, [numbers, key, after, far]) == [
        f"{span('ssn', numbers, '123-45-6789')},{span('ssn', numbers, '234-56-7890')}", span("secret", key, value),
        span("ssn", after, "234-56-7890"), span("ssn", far, "123-45-6789")]
