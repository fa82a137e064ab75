import pytest
from oracle import check

from plumbline import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_matches_sql(spark, name):
    check(spark, Q.QUERIES[name], Q.SQL[name], SF)


def test_every_query_without_sql_has_a_plain_version():
    """In test_brute_force.py."""
    assert set(Q.QUERIES) - set(Q.SQL) == {"composite_best_subset", "lz", "lz_flag", "mahad_pseudo_inverse", "response_time_mixture", "screen_default"}


def test_the_number_of_partitions_doesnt_matter(spark):
    from plumbline.frame import ResponseFrame
    from plumbline.plans.screen import screen

    f = Q.emb(spark, SF)
    a = screen(f, ["irv", "person_total", "guttman", "mahad"]).table.orderBy("ord").toPandas()
    b = screen(ResponseFrame(f.df.repartition(7), f.n_items), ["irv", "person_total", "guttman", "mahad"]).table.orderBy("ord").toPandas()
    assert (a["flag_count"] == b["flag_count"]).all()
    assert ((a["score__mahad"] - b["score__mahad"]).abs() < 1e-9).all()
