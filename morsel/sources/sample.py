"""A small corpus in two languages and code, for trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: (text, language); languages weigh WEIGHTS.
SAMPLES = (
    ("The harbour wakes before the town does. Crates are counted, ropes are coiled, and the first boat leaves without a sound.", "en"),
    ("A good index answers most questions before they are asked. A bad one only tells you that the book is long.", "en"),
    ("Rain fell on the slate roofs all morning; by noon the gutters sang, and nobody thought of going out.", "en"),
    ("Утром над рекой стоял туман, и лодки шли почти на ощупь. К полудню небо прояснилось.", "ru"),
    ("Хорошая карта не врёт, но и не рассказывает всего: тропы на ней тоньше, чем на земле.", "ru"),
    ("Старый трамвай звенел на повороте, и весь двор знал, который час.", "ru"),
    ("def area(points):\n    total = 0\n    for (a, b), (c, d) in zip(points, points[1:] + points[:1]):\n        total += a * d - b * c\n    return abs(total) / 2\n", "code"),
    ("for name in sorted(names):\n\tif name.startswith('_'):\n\t\tcontinue\n\tprint(f'{name:>12} {len(names[name])}')\n", "code"),
)
WEIGHTS = {"en": 0.4, "ru": 0.4, "code": 0.2}


def sample_corpus(spark: SparkSession) -> DataFrame:
    """(doc_id, text, language, weight)."""
    return spark.createDataFrame([(k, t, lang, WEIGHTS[lang]) for k, (t, lang) in enumerate(SAMPLES)], "doc_id long, text string, language string, weight double")
