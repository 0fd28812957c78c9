"""Functions as SQL sees them."""

from pyspark.sql import functions as F

from seqloom.functions import scalars as sc
from seqloom.functions.sql import register
from tests.test_sources import tune, wav


def test_sql_functions(spark, tmp_path):
    register(spark)
    r = spark.sql("SELECT pair_hash(100, -3, 7) AS h, normalise_name(' A-b, C! ') AS n, evidence_level(250, 3) AS l, same_passage(0, 10, 5, 15) AS p, zero_time(10, 4, 2) AS z, normalise_name('--') AS e").first()
    h = spark.range(1).select(sc.pair_hash(F.lit(100), F.lit(-3), F.lit(7))).first()[0]
    assert (r.h, r.n, r.l, r.p, r.z, r.e) == (h, "a b c", "confident", True, 8.0, None)
    wav(tmp_path / "a.wav", tune(1, 3))
    spark.read.format("binaryFile").load(str(tmp_path / "a.wav")).createOrReplaceTempView("files")
    rows = spark.sql("SELECT p.* FROM files, LATERAL wav_peaks(content) p").collect()
    assert len(rows) > 10 and [x.seq for x in rows] == list(range(len(rows)))
