"""Queries against their DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest

from rostrum.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()
CHOSEN = """agg_05_field_summary agg_06_score_profile agg_07_histogram agg_11_momentum agg_12_ols_slope agg_14_splits agg_16_partners agg_17_seasons agg_23_judge_aggregates agg_24_team_breaks
 agg_34_queue_progress join_07_score_result join_09_motion_entries join_13_exists join_19_fuzzy_names mut_01_person_upsert mut_04_motion_merge mut_10_tag_approval proj_09_speaker_average
 agg_19_volume agg_30_highlights agg_40_remarks fn_03_jaro mut_03_refresh mut_11_tag_upsert snk_02_all_fields snk_06_stored_upsert src_06_tab_function src_18_page_archive str_08_mail_stream
 str_05_limits_of_a_stream sort_06_similarity_topk snk_02_csv_export str_05_rate_limit src_06_team_tab src_12_navigation win_02_competition_rank win_03_streaks""".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CHOSEN)
def test_oracle(spark, duck, tmp_path, name):
    catalog.QUERIES[name](spark, SF).write.parquet(f"{tmp_path}/out")
    duck.sql(f"CREATE OR REPLACE TABLE s AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    duck.sql(f"CREATE OR REPLACE TABLE o AS {catalog.ORACLES[name]}")
    columns = sorted(r[0] for r in duck.sql("DESCRIBE o").fetchall())
    assert columns == sorted(r[0] for r in duck.sql("DESCRIBE s").fetchall())
    k = ", ".join(f'"{c}"' for c in columns)
    assert duck.sql(f"SELECT {k} FROM o EXCEPT ALL SELECT {k} FROM s").fetchall() == []
    assert duck.sql(f"SELECT {k} FROM s EXCEPT ALL SELECT {k} FROM o").fetchall() == []


def test_every_oracle_has_its_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
