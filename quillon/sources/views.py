"""The bibliographic views over the generated tables, in SQL that Spark and DuckDB read alike.

Each stands for an input of the operators: citation items of manuscripts, their paragraphs, library items, a collection tree,
access grants, ingest requests. Tables and views are named in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {
    "v_citation_items": """
select o.o_custkey as doc_id, o.o_orderkey as citation_id, o.o_orderdate as cited_at, l.l_linenumber as pos,
  case when l.l_linenumber = 7 then null
       when l.l_suppkey % 17 = 0 then 'http://zotero.org/users/local/p' || l.l_suppkey || '/items/K' || lpad(cast(l.l_partkey as string), 7, '0')
       else 'http://zotero.org/groups/' || (1 + l.l_suppkey % 3) || '/items/K' || lpad(cast(l.l_partkey as string), 7, '0') end as uri,
  case when p.p_partkey % 10 = 0 then 'a'
       when p.p_partkey % 10 < 7 then '10.' || (1000 + p.p_partkey % 9000) || '/' || lower(replace(p.p_brand, '#', '-')) || '.' || p.p_partkey
       else null end as doi,
  case when p.p_partkey % 97 = 0 then '' else p.p_name end as title,
  1970 + p.p_size as year, split_part(p.p_type, ' ', 1) as first_author
from {orders} o join {lineitem} l on l.l_orderkey = o.o_orderkey join {part} p on p.p_partkey = l.l_partkey""",
    "v_manuscripts": """
select c_custkey as doc_id, c_custkey % 5 <> 0 as has_prefs, case when c_custkey % 5 <> 0 then case when c_custkey % 7 = 0 then 'Bookmark' else 'Field' end end as field_type, c_custkey % 3 <> 0 as has_bibliography
from {customer}
union all select c_custkey + 10000000, c_custkey % 2 = 0, case when c_custkey % 2 = 0 then 'Field' end, false from {customer} where c_custkey % 4 = 0""",
    "v_revisions": """
select o_custkey as doc_id, 'Reviewer ' || (o_orderkey % 4) as author from {orders} where o_orderpriority = '1-URGENT'""",
    "v_citations": """
select o_custkey as doc_id, o_orderkey as citation_id, o_orderdate as cited_at, 'c' || (o_orderkey % 40) as citation_code, case when o_orderkey % 11 = 0 then 1 else 0 end as note_index from {orders}""",
    "v_refs": """
select distinct o.o_custkey as doc_id, p.p_partkey, upper(substr(p.p_name,1,1)) || substr(split_part(p.p_name,' ',1),2) as surname, 1970 + p.p_size as year, p.p_name as title, l.l_linenumber as pos, o.o_orderkey as citation_id
from {orders} o join {lineitem} l on l.l_orderkey = o.o_orderkey join {part} p on p.p_partkey = l.l_partkey""",
    "v_paragraphs": f"""
select doc_id, row_number() over (partition by doc_id order by citation_id) - 1 as para, 'As reported (' || a1 {' '.join(f"|| coalesce('; ' || a{k}, '')" for k in range(2, 8))} || ') in table 3(12).' as text
from (select doc_id, citation_id, {', '.join(f"min(case when pos = {k} then surname || {'^^ & Hall, ^^' if k > 1 else '^^ et al., ^^'} || year end) as a{k}" for k in range(1, 8))} from {{v_refs}} group by doc_id, citation_id) x where a1 is not null
""".replace("^^", "'")
    + """union all select distinct doc_id, 100000, 'REFERENCES (NOT FINAL)' from {v_refs}
union all select doc_id, 100000 + row_number() over (partition by doc_id order by p_partkey), case when p_partkey % 3 = 0 then p_partkey % 90 || '. ' else '' end || surname || ', A. (' || year || '). ' || title || '.' || case when p_partkey % 2 = 0 then ' https://doi.org/10.' || (1000 + p_partkey % 9000) || '/x.' || p_partkey || '.' when p_partkey % 5 = 0 then ' https://example.org/p/' || p_partkey else '' end
from (select distinct doc_id, p_partkey, surname, year, title from {v_refs}) y""",
    # Every tenth page is held twice: the other copy has no DOI and a tracked address.
    "v_items": """
select page_id, 'K' || lpad(cast(page_id as string), 7, '0') as item_key, 'groups/' || (1 + page_id % 2) as library, url, title,
  case when page_id % 3 = 0 and not again then '10.' || (1000 + length(title)) || '/' || substr(md5(title), 1, 8) end as doi,
  case when isbn_at then '978' || lpad(cast(length(title) * 7919 as string), 10, '0') end as isbn,
  'N' || (page_id % 25) as collection_key, 1 + page_id % 9 as version
from (select page_id, url, regexp_extract(html, '<title>(.*?)</title>', 1) as title, page_id % 5 = 0 as isbn_at, false as again from {pages}
  union all select page_id + 5000001, url || case when contains(url, '?') then '&' else '?' end || 'utm_campaign=again', regexp_extract(html, '<title>(.*?)</title>', 1), true, true from {pages} where page_id % 10 = 5 and not contains(url, '#')) t""",
    "v_collections": """
select 'ROOT' as collection_key, 'Root' as name, cast(null as string) as parent
union all select 'R' || r_regionkey, r_name, 'ROOT' from {region}
union all select 'N' || n_nationkey, n_name, 'R' || n_regionkey from {nation}
union all select 'C' || c_custkey, c_name, 'N' || c_nationkey from {customer}""",
    "v_grants": """
select s_nationkey as user_id, s_nationkey % 7 = 0 as personal_write, s_nationkey % 5 = 0 as all_write, s_suppkey as group_id, s_acctbal < 2000 as can_write from {supplier}""",
    "v_ingest_events": """
select event_id, user_id as binding_id, event_type || ':' || props as identifier, ts as created_at from {events}""",
    # Raw identifiers as people type them: a DOI, a resolver's URL, an ISBN with and without its prefix, a page, a PubMed and a preprint id.
    "v_identifiers": """
select page_id, 1 as n, doi as raw from {v_items}
union all select page_id, 2, 'https://doi.org/' || doi from {v_items}
union all select page_id, 3, isbn from {v_items}
union all select page_id, 4, 'ISBN: ' || substr(isbn, 1, 3) || '-' || substr(isbn, 4, 10) from {v_items}
union all select page_id, 5, url from {v_items}
union all select page_id, 6, 'pmid: ' || page_id from {v_items}
union all select page_id, 7, 'arXiv:21' || lpad(cast(page_id % 12 + 1 as string), 2, '0') || '.' || lpad(cast(page_id % 100000 as string), 5, '0') from {v_items}
union all select page_id, 8, substr(title, 1, 12) from {v_items}
union all select page_id, 9, substr(isbn, 4, 9) || 'X' from {v_items}
union all select page_id, 10, chr(9) || doi || chr(10) from {v_items}
union all select page_id, 11, chr(160) || url || chr(13) || ' ' from {v_items}""",
}


class Tables:
    """Tables of one folder and the views over them, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.sql(VIEWS[name])
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        used = set(re.findall(r"\{(\w+)\}", text))
        return self.spark.sql(text, **{u: self(u) for u in used})


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it uses, in braces like the tables."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\{(v_\w+)\}", text):
            if name not in need:
                visit(VIEWS[name])
                need.append(name)

    visit(sql)
    plain = lambda text: re.sub(r"\{(\w+)\}", lambda m: m[1] if m[1] in VIEWS or m[1] in TABLES else m[0], text)
    ctes = ",\n".join(f"{n} as ({plain(VIEWS[n])})" for n in need)
    body = plain(sql).strip()
    if not ctes:
        return body
    if body.lower().startswith("with recursive "):
        return f"with recursive {ctes},\n{body[15:]}"
    return f"with {ctes},\n{body[5:]}" if body.lower().startswith("with ") else f"with {ctes}\n{body}"
