"""Queries against their SQL on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from sextant import queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = "w1_midrank_top20 f10_anchors f13_canonical_link f14_registered_domain f16_strip_tags s10_listing_cards f33_eligibility f34_scores a02_breakdowns a06_verdict_cube a08_coverage v01_contest_view v02_market_view w08_cross_source_dedup u02_upsert u03_patch j06_anchor_pairs v14_clusters t06_bands f38_profile_bump a18_source_health f48_business_days st07_daily_volume st01_unseen_items st03_once_by_key s13_rss_feeds s06_json_api v08_umbrella_split u08_robot_write j16_reply_context w10_next_tasks_text g01_contest_notices g02_regex_conjunction g09_situation g13_single_notices f15_entities f22_regime_and_class f24_enrolment_window f25_state_in_text f28_contract_salary_stack f46_checked_fields v11_posting_pipeline t10_sampling_cap s04_gazette_items p02_gazette_records s09_blog_posts p06_blog_records s11_board_cards p08_board_records s12_job_postings p09_detail_fields s16_decoded_bytes u01_insert_if_absent u04_reprocess u05_fill_missing u06_harvest_flags u12_state_refresh j03_canonical_acronyms j13_restored_flags st05_minimum_gap st06_resumable_backfill st07_volume_alerts st08_isolated_failures a15_feed_freshness v12_news_pipeline v07_staleness f40_project_health k06_report_tables v05_today_board v09_offers_section v10_relevant_subnotices t05_diversity_floors p01_closed_schema p12_news_records p14_contest_block s03_latest_health j02_longest_name_in_text a27_mapped_share j01_term_hits g04_principal_area a11_cluster_summary a12_jaccard_histogram u12x_published_state j14_restored_fields s18_source_adapter s18x_adapter_errors st04_first_seen st08x_error_rows v12x_news_store".split()


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return None if math.isnan(v) else float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v.isoformat() if isinstance(v, datetime.date) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, duck, name):
    df = queries.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    found = sorted((tuple(plain(x) for x in r) for r in df.select(*columns).collect()), key=repr)
    cursor = duck.execute(queries.oracle_sql()[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    assert found == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
