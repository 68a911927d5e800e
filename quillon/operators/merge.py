"""Merging what a translator found with what a caller asserts, field by field, with an account of where each part came from.

An entry is (source_type, item: map of fields, creators, item_type, metadata: map of neutral keys, fields: map, authors, editors).
The item types are a small table, a row each with its slots worked out; entries meet it by their type, and the rest is one projection per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C

c = F.col
# Fields and creator roles (primary first) of eight item types; a library's own tables may be passed in their place.
TYPE_FIELDS: dict[str, list[str]] = {
    "webpage": "title abstractNote websiteTitle websiteType date shortTitle url accessDate language rights extra".split(),
    "newspaperArticle": "title abstractNote publicationTitle place edition date section pages language shortTitle ISSN url accessDate extra".split(),
    "report": "title abstractNote reportNumber reportType seriesTitle place institution date pages language shortTitle url accessDate extra".split(),
    "book": "title abstractNote series seriesNumber volume edition place publisher date numPages language ISBN shortTitle url accessDate extra".split(),
    "bookSection": "title abstractNote bookTitle series edition place publisher date pages language ISBN shortTitle url accessDate extra".split(),
    "statute": "nameOfAct abstractNote code codeNumber publicLawNumber dateEnacted pages section session history language shortTitle url accessDate extra".split(),
    "presentation": "title abstractNote presentationType date place meetingName url accessDate language extra".split(),
    "journalArticle": "title abstractNote publicationTitle volume issue pages date DOI ISSN url accessDate extra".split(),
}
TYPE_CREATORS: dict[str, list[str]] = {
    "webpage": "author contributor translator".split(), "newspaperArticle": "author contributor reviewedAuthor translator".split(), "report": "author contributor translator seriesEditor".split(),
    "book": "author contributor editor translator seriesEditor".split(), "bookSection": "author contributor editor bookAuthor translator".split(), "statute": "author contributor".split(),
    "presentation": "presenter contributor".split(), "journalArticle": "author contributor editor reviewedAuthor translator".split(),
}
CREATOR = "array<struct<creator_type:string,last_name:string,first_name:string,name:string>>"
CHANGE = "array<struct<field:string,translator:string,caller:string>>"


def type_tables(spark: SparkSession, fields: dict[str, list[str]] | None = None, creators: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """The item types as tables: (item_type, field, n) and (item_type, role, n)."""
    rows = lambda table: [(kind, x, n) for kind, xs in table.items() for n, x in enumerate(xs)]
    return spark.createDataFrame(rows(fields or TYPE_FIELDS), "item_type string, field string, n int"), spark.createDataFrame(rows(creators or TYPE_CREATORS), "item_type string, role string, n int")


def types(fields: DataFrame, creators: DataFrame) -> DataFrame:
    """A row for each item type: its fields, its roles, the field of each family (`slots`), the fields whose values find a place there (`room`), and the neutral keys that it takes."""
    listed = lambda name: F.transform(F.array_sort(F.collect_list(F.struct("n", name))), lambda x: x[name])
    rows = fields.groupBy("item_type").agg(listed("field").alias("valid")).join(creators.groupBy("item_type").agg(listed("role").alias("roles")), "item_type", "left")
    names = {f: F.array(*(F.lit(m) for m in members)) for f, members in C.FAMILIES.items()}
    slots = F.map_filter(F.create_map(*(x for f in names for x in (F.lit(f), C.type_slot(c("valid"), f)))), lambda k, v: v.isNotNull())
    rows = rows.withColumn("slots", slots)
    whole = lambda f: F.when(F.map_contains_key("slots", F.lit(f)), names[f]).otherwise(F.array().cast("array<string>"))
    room = F.array_distinct(F.concat("valid", F.array(*(F.lit(k) for k in C.STRUCTURAL)), *(whole(f) for f in names)))
    plain = F.array_compact(F.array(*(F.when(F.array_contains("valid", F.lit(f)), k) for k, f in C.PLAIN.items())))
    return rows.withColumns({"room": room, "takes": F.concat(F.map_keys("slots"), plain)})


def _filled(m: Column) -> Column:
    return F.map_filter(m, lambda k, v: v.isNotNull() & (v != ""))


def rehomed(item: Column, valid: Column, slots: Column) -> Column:
    """The item's values on the fields of another type: the same field, or the family's field if nothing stands there yet."""
    same = F.map_filter(item, lambda k, v: v.isNotNull() & (F.array_contains(valid, k) | k.isin(*C.STRUCTURAL)))
    first = lambda members: F.get(F.filter(F.transform(F.array_intersect(F.map_keys(item), F.array(*(F.lit(m) for m in members))), lambda k: F.element_at(item, k)), lambda v: v.isNotNull()), F.lit(0))
    family = [F.struct(F.try_element_at(slots, F.lit(f)).alias("key"), first(members).alias("value")) for f, members in C.FAMILIES.items()]
    moved = F.filter(F.array(*family), lambda e: e["key"].isNotNull() & e["value"].isNotNull() & ~F.map_contains_key(same, e["key"]))
    return F.map_concat(same, F.map_from_entries(moved))


def homeless(item: Column, room: Column) -> Column:
    """Values that the new type has no room for; empty ones and structure aren't reported."""
    return F.map_filter(_filled(item), lambda k, v: ~F.array_contains(room, k))


def asserted_fields(metadata: Column, valid: Column, slots: Column) -> Column:
    """The caller's neutral keys as fields of the type; keys without a field there are left out (see `error`)."""
    family = [F.struct(F.try_element_at(slots, F.lit(f)).alias("key"), F.try_element_at(metadata, F.lit(f)).alias("value")) for f in C.FAMILIES]
    isbn = F.try_element_at(metadata, F.lit("isbn"))
    plain = [F.struct(F.lit(f).alias("key"), (F.coalesce(C.isbn13(isbn), isbn) if k == "isbn" else F.try_element_at(metadata, F.lit(k))).alias("value")) for k, f in C.PLAIN.items()]
    entries = F.filter(F.array(*family, *plain), lambda e: e["key"].isNotNull() & F.array_contains(valid, e["key"]) & e["value"].isNotNull() & (e["value"] != ""))
    return F.map_from_entries(entries)


def overlay(item: Column, new: Column) -> Column:
    kept = F.map_filter(item, lambda k, v: ~F.map_contains_key(new, k))
    return F.map_concat(kept, new)


def overridden(item: Column, new: Column) -> Column:
    """Fields where the caller beats a different value, with both."""
    rows = F.transform(F.map_entries(new), lambda e: F.struct(e["key"].alias("field"), F.try_element_at(item, e["key"]).alias("translator"), e["value"].alias("caller")))
    return F.array_sort(F.filter(rows, lambda r: r["translator"].isNotNull() & (r["translator"] != "") & (r["translator"] != r["caller"])))


def only_asserted(item: Column, new: Column) -> Column:
    return F.map_filter(new, lambda k, v: F.coalesce(F.try_element_at(item, k), F.lit("")) == "")


def kept_creators(creators: Column, old_primary: Column, new_roles: Column) -> Column:
    """Creators after a change of type: the old primary role becomes the new one, other allowed roles stay, the rest go."""
    allowed = F.filter(creators, lambda x: (x["creator_type"] == old_primary) | F.array_contains(new_roles, x["creator_type"]))
    role = lambda x: F.when(x["creator_type"] == old_primary, F.get(new_roles, F.lit(0))).otherwise(x["creator_type"])
    return F.transform(allowed, lambda x: F.struct(role(x).alias("creator_type"), x["last_name"].alias("last_name"), x["first_name"].alias("first_name"), x["name"].alias("name")))


def placed_creators(creators: Column, new: Column, role: Column, primary: Column) -> Column:
    """A caller's creators of one role replace that role's: in front for the primary role, at the end for others."""
    rest = F.filter(creators, lambda x: x["creator_type"] != role)
    return F.when(role == primary, F.concat(new, rest)).otherwise(F.concat(rest, new))


def merge(entries: DataFrame, kinds: DataFrame | None = None, today: str = "2026-01-01") -> DataFrame:
    """Entries with target_type, merged, overridden, asserted, dropped, defaulted, merged_creators, error, source.

    `kinds` are the item types (see `types`), a row each, that entries meet by their type. `error` is the first rule that fails, null if
    none: unknown metadata key, no type, unknown type, a key without a field in the type, an unknown field, a role that the type lacks,
    an empty name among the creators, no title. A row with an error keeps its other columns.
    """
    kinds = types(*type_tables(entries.sparkSession)) if kinds is None else kinds
    empty, none = F.create_map().cast("map<string,string>"), F.array().cast("array<string>")
    known = [*C.FAMILIES, *C.PLAIN, "authors", "editors", "fields"]
    df = entries.withColumns({"item": F.coalesce("item", empty), "metadata": F.coalesce("metadata", empty), "fields": F.coalesce("fields", empty), "creators": F.coalesce("creators", F.array().cast(CREATOR))})
    df = df.withColumn("target_type", F.coalesce("item_type", "source_type"))
    df = df.join(kinds.withColumnRenamed("item_type", "target_type"), "target_type", "left").join(kinds.select(c("item_type").alias("source_type"), F.get("roles", F.lit(0)).alias("old_role")), "source_type", "left")
    df = df.withColumns({"valid": F.coalesce("valid", none), "roles": F.coalesce("roles", none), "room": F.coalesce("room", none), "takes": F.coalesce("takes", none), "slots": F.coalesce("slots", empty), "old_role": F.coalesce("old_role", F.lit("author"))})
    same = c("source_type").eqNullSafe(c("target_type"))
    df = df.withColumns({"translated": F.when(same, c("item")).otherwise(rehomed(c("item"), c("valid"), c("slots"))), "dropped": F.when(same, empty).otherwise(homeless(c("item"), c("room")))})
    df = df.withColumn("neutral", asserted_fields(c("metadata"), c("valid"), c("slots"))).withColumn("named", F.map_filter("fields", lambda k, v: F.array_contains(c("valid"), k)))
    df = df.withColumn("first_pass", overlay(c("translated"), c("neutral")))
    df = df.withColumns({
        "overridden": F.concat(overridden(c("translated"), c("neutral")), overridden(c("first_pass"), c("named"))),
        "asserted": overlay(only_asserted(c("translated"), c("neutral")), only_asserted(c("first_pass"), c("named"))),
        "merged": overlay(c("first_pass"), c("named")),
    })
    primary = F.get("roles", F.lit(0))
    kept = F.when(same, c("creators")).otherwise(kept_creators(c("creators"), c("old_role"), c("roles")))
    people = lambda names, role: F.filter(F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda x: C.creator(x, role)), lambda x: x.isNotNull())
    df = df.withColumn("kept", kept)
    df = df.withColumn("merged_creators", F.when(c("authors").isNull(), c("kept")).otherwise(placed_creators(c("kept"), people(c("authors"), primary), primary, primary)))
    df = df.withColumn("merged_creators", F.when(c("editors").isNull(), c("merged_creators")).otherwise(placed_creators(c("merged_creators"), people(c("editors"), F.lit("editor")), F.lit("editor"), primary)))
    fill = F.map_filter(F.create_map(F.lit("url"), F.when(c("kind") == "url", c("identifier")), F.lit("ISBN"), F.when(c("kind") == "isbn", c("identifier"))), lambda k, v: v.isNotNull())
    fill = F.map_filter(fill, lambda k, v: F.array_contains(c("valid"), k) & (F.coalesce(F.try_element_at(c("merged"), k), F.lit("")) == ""))
    df = df.withColumn("defaulted", fill).withColumn("merged", overlay(c("merged"), c("defaulted")))
    said = (F.size("overridden") > 0) | (F.size("asserted") > 0)
    dated = said & (F.coalesce(F.try_element_at("merged", F.lit("url")), F.lit("")) != "") & (F.coalesce(F.try_element_at("merged", F.lit("accessDate")), F.lit("")) == "") & F.array_contains("valid", "accessDate")
    access = F.create_map(F.lit("accessDate"), F.lit(today))
    df = df.withColumns({"defaulted": F.when(dated, overlay(c("defaulted"), access)).otherwise(c("defaulted")), "merged": F.when(dated, overlay(c("merged"), access)).otherwise(c("merged"))})
    unplaced = F.filter(F.map_keys(_filled(c("metadata"))), lambda k: k.isin(*C.FAMILIES, *C.PLAIN) & ~F.array_contains("takes", k))
    unnamed = lambda names: F.exists(F.coalesce(c(names), none), lambda x: C.strip(F.coalesce(x, F.lit(""))) == "")
    error = (
        F.when(F.size(F.array_except(F.map_keys("metadata"), F.array(*(F.lit(k) for k in known)))) > 0, "unknown metadata keys").when(c("target_type").isNull(), "no item type")
        .when(F.size("valid") == 0, "unknown item type").when(F.size(unplaced) > 0, "no field for a metadata key").when(F.size("named") < F.size("fields"), "unknown field")
        .when(c("editors").isNotNull() & ~F.array_contains("roles", "editor"), "role not allowed")
        .when(unnamed("authors") | unnamed("editors"), "an empty name").when(C.family_value(c("merged"), "title").isNull(), "no title")
    )
    caller = c("item_type").isNotNull() | (F.size("metadata") > 0) | (F.size("fields") > 0)
    source = F.when(~caller, "translator").when(F.size("item") > 0, "translator+caller").otherwise("caller")
    return df.withColumns({"error": error, "source": source}).drop("valid", "roles", "slots", "room", "takes", "old_role", "translated", "neutral", "named", "first_pass", "kept")


# What an entry may say, and the kinds of identifiers that are registered, so that one that leads nowhere is wrong.
ENTRY_KEYS = ("id", "hint", "ref", "ref_key", "item_type", "metadata")
REGISTERED = ("doi", "pmid", "arxiv")


def _steps(m: DataFrame) -> dict[str, Column]:
    """The ways on which a row leaves the plan before its record is looked at, in their order, and whether it takes them."""
    given = F.coalesce("said_keys", F.array().cast("array<string>")) if "said_keys" in m.columns else F.array().cast("array<string>")
    failed, caller = c("identifier").isNotNull() & ~c("resolved"), c("source") != "translator"
    unknown = F.size(F.array_except(given, F.array(*(F.lit(k) for k in ENTRY_KEYS)))) > 0
    steps = {"unknown": unknown, "nothing": c("identifier").isNull() & ~caller, "nameless": failed & c("kind").isNull(), "registered": failed & c("kind").isin(*REGISTERED), "bare": failed & ~caller}
    out, left = {"given": given, "failed": ~unknown & failed, "caller": caller}, F.lit(True)
    for name, step in steps.items():
        out[name] = left & F.coalesce(step, F.lit(False))
        left = left & ~F.coalesce(step, F.lit(False))
    out["bad"] = left & caller & c("error").isNotNull()
    out["fine"] = left & ~(caller & c("error").isNotNull())
    return out


def warnings(m: DataFrame) -> Column:
    """What a person should look at before a row goes in, or why it doesn't, in the order in which it comes up: fifteen kinds."""
    s = _steps(m)
    title, theirs = F.try_element_at("metadata", F.lit("title")), C.family_value(c("item"), "title")
    pdf, listed = (c("kind") == "url") & C.is_pdf(c("identifier")), lambda x: F.array_join(F.array_sort(x), ", ")
    said = [
        (s["unknown"], F.concat(F.lit("unknown entry keys: "), listed(F.array_except(s["given"], F.array(*(F.lit(k) for k in ENTRY_KEYS)))))),
        (s["nothing"], F.lit("neither an identifier nor a record")),
        (s["failed"], F.lit("the identifier led to nothing")),
        (s["nameless"] & s["caller"], F.lit("leave out an identifier that is none")),
        (s["registered"], F.concat(F.lit("a "), c("kind"), F.lit(" that leads nowhere was probably copied wrong"))),
        (s["bare"] & pdf, F.lit("a PDF is rarely read: give type and metadata")),
        (s["bare"] & (c("kind") == "isbn"), F.lit("no catalogue has this ISBN: give type and metadata")),
        (s["failed"] & (s["bad"] | s["fine"]), F.lit("nothing was read: built from the caller's metadata")),
        (s["bad"], c("error")),
        (s["fine"] & c("target_type").isin(*C.UNCERTAIN_TYPES) & c("item_type").isNull(), F.lit("uncertain type")),
        (s["fine"] & (c("source") == "translator") & pdf, F.lit("read from a PDF")),
        (s["fine"] & (F.size("dropped") > 0), F.concat(F.lit("no room for: "), listed(F.map_keys("dropped")))),
        (s["fine"] & (F.size("item") > 0) & C.null_if_empty(title).isNotNull() & ~C.titles_agree(theirs, title), F.lit("titles disagree")),
        (s["fine"] & (c("source") == "caller"), F.lit("caller's metadata alone")),
        (s["fine"] & C.null_if_empty(c("hint")).isNotNull() & C.null_if_empty(c("got")).isNotNull() & ~C.names_agree(c("hint"), c("got")), F.lit("another first author")),
    ]
    return F.array_compact(F.array(*(F.when(when, text) for when, text in said)))


def plan_rows(entries: DataFrame, kinds: DataFrame | None = None, today: str = "2026-01-01") -> DataFrame:
    """Entries (identifier, kind, resolved, hint, and said_keys where they are known) to rows with outcome invalid, unresolved or new, and their
    warnings, before deduplication. What an identifier that wasn't resolved seems to hold is left out."""
    only = lambda name: F.when(c("resolved"), c(name))
    m = merge(entries.withColumns({x: only(x) for x in ("item", "creators", "source_type")}), kinds, today)
    first = lambda people: F.coalesce(F.get(people, F.lit(0))["last_name"], F.get(people, F.lit(0))["name"])
    m = m.withColumn("got", F.coalesce(first("creators"), first("merged_creators")))
    s = _steps(m)
    outcome = F.when(s["unknown"] | s["nothing"] | (s["nameless"] & s["caller"]) | s["bad"], "invalid").when(s["nameless"] | s["registered"] | s["bare"], "unresolved").otherwise("new")
    return m.withColumn("outcome", outcome).withColumn("warnings", warnings(m))


CALLER_TAG = "caller-metadata"


def written(rows: DataFrame, collection: Column, verdict: Column) -> DataFrame:
    """Merged rows as the library gets them: `item` without bookkeeping, its one `collections`, and `tags`.

    A row that a caller had a hand in is tagged, and so is the bearing of a verified one; a verdict without a bearing adds none.
    """
    bearing = F.try_element_at(F.create_map(*(F.lit(x) for kv in C.BEARINGS.items() for x in kv)), F.lower(verdict))
    tags = F.array_compact(F.array(F.when(c("source") != "translator", CALLER_TAG), bearing))
    kept = F.map_filter("merged", lambda k, v: ~k.isin(*C.BOOKKEEPING))
    return rows.withColumns({"item": kept, "collections": F.array(collection), "tags": tags})
