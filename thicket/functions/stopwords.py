"""Stop words: a short list of English function words, or any list from a file.

Long published lists are not part of this package; ``read_stop_words`` takes
the path of one (a word a line), wherever Spark can read it.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Articles, pronouns, auxiliary verbs, prepositions and conjunctions.
STOP_WORDS = frozenset(
    """
a about above after again against all also although am among an and any are around as at
be because been before being below between both but by
can cannot could
did do does doing down during
each either else
few for from further
had has have having he her here hers herself him himself his how however
i if in into is it its itself
just
may me might more most must my myself
neither no nor not now
of off on once only onto or other our ours ourselves out over own
per
same shall she should since so some such
than that the their theirs them themselves then there these they this those though through thus to too toward
under until up upon us
very
was we were what when where whether which while who whom whose why will with within without would
yet you your yours yourself yourselves
""".split()
)


def read_stop_words(spark: SparkSession, path: str) -> frozenset[str]:
    """A word a line; blank lines and white space around words don't count. The list meets in the driver."""
    return frozenset(w for row in spark.read.text(path).collect() if (w := row.value.strip()))
