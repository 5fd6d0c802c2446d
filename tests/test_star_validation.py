"""The checks of the star read the large tables a fixed number of times."""

from __future__ import annotations

from ledgerline.plans import standard

SF = "/root/testdata/sf0.001"


def test_lines_are_read_once_for_each_view(spark, monkeypatch):
    rows, plain = spark.sparkContext.accumulator(0), standard.table

    def counted(spark_, sf_dir, name):
        frame = plain(spark_, sf_dir, name)
        if name != "lineitem":
            return frame

        def run(batches):
            for batch in batches:
                rows.add(batch.num_rows)
                yield batch

        return frame.mapInArrow(run, frame.schema)

    monkeypatch.setattr(standard, "table", counted)
    assert standard.star_validation(spark, SF).where("violations > 0").count() == 0
    # Once for the matches, once for the scorers.
    assert rows.value == 2 * plain(spark, SF, "lineitem").count()
