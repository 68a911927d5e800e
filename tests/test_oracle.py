"""A selection of registered queries against their SQL; the driver compares all of them."""

import pytest

NAMES = [
    "fold_spaced", "fold_compact", "classify_identifier", "normalise_identifier", "isbn13", "url_key", "titles_agree", "citation_key",
    "chk_duplicate_surrogate", "chk_malformed_doi", "audit_all", "sort_findings", "gen_candidates", "join_atom_reference", "discovery_summary",
    "dedup_ladder", "join_legs", "subtree", "join_target", "file_items", "collection_view", "merge_type_change", "merge_assert", "plan_one",
    "scope_verdict", "anti_ledger", "plan_apply", "plan_apply_filing", "plan_counts", "apply_report", "sink_discovery", "sort_recent", "gen_runs", "marker_placement", "gen_citations", "field_invariants", "stream_ledger", "stream_version_guard",
]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(compare, name):
    ours, theirs = compare(name)
    assert ours == theirs


def test_whole_field_codes_equal_sql(compare):
    ours, theirs = compare("gen_field_codes_whole")
    assert ours == theirs and any(len(codes) > 54 for codes, _ in ours)


def test_whole_plan_applies_once(compare):
    ours, theirs = compare("plan_apply_all")
    assert ours == theirs and len(ours) > 0


def test_candidates_in_order_equal_sql(compare):
    ours, theirs = compare("win_candidate_order")
    assert ours == theirs and {"url", "title"} <= {r[3] for r in ours}


@pytest.mark.parametrize("name", ["dedup_url", "dedup_title"])
def test_candidates_are_named_as_in_sql(compare, name):
    import __spark_entry__ as entry

    ours, theirs = compare(name)
    assert ours == theirs and "string_agg(target" in entry.oracle_sql()[name]
    assert all((candidates is None) == (match not in ("same-url", "title")) for candidates, _, _, match, *_ in ours)
    assert name == "dedup_url" or any("," in r[0] for r in ours)


def test_citation_key_is_worked_out_once(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["citation_key"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1


def test_registry_is_complete():
    import __spark_entry__ as entry

    names = entry.queries()
    assert len(names) >= 145
    assert set(entry.oracle_sql()) <= set(names)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["audit_all", "sort_findings"])
def test_items_of_the_audit_are_not_sorted_to_be_joined(spark, name):
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ShuffledHashJoin") >= 4
    assert not any("SortMergeJoin" in x and ("partkey" in x or "orderkey" in x) for x in plan.splitlines())
