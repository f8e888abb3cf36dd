"""Character references against the standard library's."""

import html
from html.entities import html5

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import reading as R


def unescaped(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").orderBy("i").select(R.unescape(F.col("x")).alias("y"))
    return [r.y for r in rows.collect()]


def test_every_name_and_many_numbers(spark):
    names = [f"&{n}{tail}" for n in html5 for tail in ("", "x", ";")]
    numbers = [f"&#{n};" for n in [*range(320), 55295, 55296, 57343, 57344, 64975, 64976, 65007, 65008, 65533, 65534, 65535, 131069, 131070, 1114109, 1114110, 1114111, 1114112]]
    odd = ["&#" + "9" * 60 + ";", "&#x" + "0" * 60 + "41;", "&#xZ;", "&#;", "&#x;", "&", "&&", "&;", "", "&#65", "&#x41g", "&notit;", "&notin;", "&\n", "& amp;", "a&amp;b&lt;c", "&" + "a" * 40 + ";", None]
    texts = names + numbers + odd
    assert unescaped(spark, texts) == [None if t is None else html.unescape(t) for t in texts]


_PARTS = st.one_of(st.sampled_from(["&", "&#", "&#x", ";", "amp", "lt", "not", "copy", " ", "\n", "é", "😀"]), st.sampled_from(sorted(html5)), st.integers(0, 1_200_000).map(str), st.text("0123456789abcdefXx&#;<", max_size=6))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(_PARTS, max_size=8).map("".join), min_size=1, max_size=400))
def test_mixtures(spark, texts):
    assert unescaped(spark, texts) == [html.unescape(t) for t in texts]


def test_requests_have_defaults(spark):
    rows = ['{"text":" a ","lang":"","rate":0,"pitch":"1.5"}', '{"text":"b","voice":" V ","lang":"de-DE","rate":2}', '{"text":"  "}', "no json", None]
    got = spark.createDataFrame(list(enumerate(rows)), "i int, r string").orderBy("i").select(R.speech_request(F.col("r")).alias("r")).collect()
    assert [tuple(x.r) for x in got] == [("a", "", "en-US", 1.0, 1.5, None), ("b", "V", "de-DE", 2.0, 1.0, None)] + [("", "", "en-US", 1.0, 1.0, "empty_text")] * 3
