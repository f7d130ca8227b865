"""The record store: visibility, search over nested records, persistence and the calls of its API.

Frames: snapshots (resume_id, document_id, candidate_id, parse_status, parse_config_hash, is_latest,
resume_data JSON, skills array, created_at, deleted_at), documents (document_id, deleted_at),
candidates (candidate_id, deleted_at). Records are parsed permissively: a field of another type
than stated, such as a text for the array `experience`, is null and matches nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import filtered, latest, page

RECORD = "personal struct<name string, email string, phone string, location string>, summary string, skills array<string>, experience array<struct<company string, designation string, location string, startDate string, endDate string, current boolean, description string, technologies array<string>>>, education array<struct<institution string, degree string, grade string>>"
#: Statuses that a stored parse may be reused with.
REUSABLE = ("SUCCESS", "PARTIAL")


def visible(snapshots: DataFrame, documents: DataFrame, candidates: DataFrame, *, include_deleted: bool = False) -> DataFrame:
    """Snapshots with their document and candidate (if any), none of them deleted."""
    docs = documents.select("document_id", F.col("deleted_at").alias("__doc_deleted"))
    people = candidates.select("candidate_id", F.col("deleted_at").alias("__candidate_deleted"))
    joined = snapshots.join(docs, "document_id").join(people, "candidate_id", "left")
    if not include_deleted:
        joined = joined.where("deleted_at is null and __doc_deleted is null and (candidate_id is null or __candidate_deleted is null)")
    return joined.drop("__doc_deleted", "__candidate_deleted")


def opened(rows: DataFrame) -> DataFrame:
    """Adds `record`, the parsed resume_data; what doesn't parse is null."""
    return rows.withColumn("record", F.from_json("resume_data", RECORD))


def _in(part: str | None) -> str | None:
    return None if part is None else f"%{part}%"


def search(rows: DataFrame, *, status: str | None = None, candidate: str | None = None, is_latest: bool | None = None, after=None, before=None, name: str | None = None, location: str | None = None, company: str | None = None, designation: str | None = None, skills: str | None = None, text: str | None = None) -> DataFrame:  # noqa: ANN001
    """Visible, opened rows that meet all that is given. Substrings ignore case, and % and _ in them
    keep their meaning; skills are a comma list of which every one has to be like one of the row's."""

    def in_jobs(field: str) -> Column:
        return F.exists(F.col("record.experience"), lambda e: e[field].ilike(wanted[field]))

    def has_skill(term: str) -> Column:
        return F.exists("skills", lambda s: s.ilike(term))

    wanted = {"company": _in(company), "designation": _in(designation), "location": _in(location)}
    found = {f: in_jobs(f) for f in wanted if wanted[f]}
    place = None if location is None else F.col("record.personal.location").ilike(_in(location)) | F.coalesce(found["location"], F.lit(False))
    terms = list(dict.fromkeys(t.strip() for t in (skills or "").split(",") if t.strip()))
    known = [has_skill(t) for t in terms]
    free = None
    if text is not None:
        free = F.col("record.personal.name").ilike(_in(text)) | F.coalesce(F.col("record.summary").ilike(_in(text)), F.lit(False)) | F.coalesce(F.exists("record.experience", lambda e: e["company"].ilike(_in(text))), F.lit(False))
    return filtered(
        rows,
        None if status is None else F.col("parse_status") == status,
        None if candidate is None else F.col("candidate_id") == candidate,
        None if is_latest is None else F.col("is_latest") == is_latest,
        None if after is None else F.col("created_at") >= after,
        None if before is None else F.col("created_at") <= before,
        None if name is None else F.col("record.personal.name").ilike(_in(name)),
        place,
        found.get("company"),
        found.get("designation"),
        *known,
        free,
    )


def listing(rows: DataFrame, limit: int, offset: int) -> tuple[DataFrame, DataFrame]:
    """One page, newest first with ids breaking ties, and one row (total, has_more)."""
    one = page(rows, [F.desc("created_at"), F.desc("resume_id")], limit, offset)
    return one, rows.agg(F.count(F.lit(1)).alias("total")).withColumn("has_more", F.col("total") > offset + limit)


def get(rows: DataFrame, resume_id, provenance: DataFrame | None = None) -> DataFrame:  # noqa: ANN001
    """The record of an id, with its provenance row if it has one."""
    one = rows.where(F.col("resume_id") == resume_id)
    return one if provenance is None else one.join(provenance, "resume_id", "left")


def insert(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The table after the insert: rows whose key it has already are replays and change nothing."""
    return stored.unionByName(incoming.dropDuplicates([key]).join(stored.select(key), key, "left_anti").select(*stored.columns))


def responses(requests: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Idempotency: requests with the stored response of their key, and `replayed`."""
    return requests.join(stored, key, "left").withColumn("replayed", F.col("response").isNotNull())


def reusable(snapshots: DataFrame, requests: DataFrame) -> DataFrame:
    """For each request (request_id, document_id, parse_config_hash) the newest reusable snapshot, or null."""
    fit = snapshots.where(F.col("parse_status").isin(*REUSABLE) & F.col("deleted_at").isNull())
    newest = latest(fit.select("document_id", "parse_config_hash", "resume_id", "created_at"), ["document_id", "parse_config_hash"], ["created_at", "resume_id"])
    return requests.join(newest, ["document_id", "parse_config_hash"], "left").select("request_id", "resume_id")


def demoted(snapshots: DataFrame) -> DataFrame:
    """`is_latest` as inserts leave it: the newest of each document."""
    best = snapshots.groupBy("document_id").agg(F.max(F.struct("created_at", "resume_id")).alias("__best"))
    return snapshots.drop("is_latest").join(best, "document_id").withColumn("is_latest", F.struct("created_at", "resume_id") == F.col("__best")).drop("__best")


def long_form(rows: DataFrame) -> DataFrame:
    """Opened rows as (resume_id, section, item_index, field, value): trimmed, blanks and nulls left out,
    booleans written True and False, technologies numbered."""

    def one(section: str, index: Column, field: Column, value: Column, kind: str = "") -> Column:
        text = F.initcap(value.cast("string")) if kind == "boolean" else value.cast("string")
        return F.struct(F.lit(section).alias("section"), index.cast("long").alias("item_index"), field.alias("field"), F.trim(text).alias("value"))

    zero = F.lit(0)
    parts = [F.array(*[one("personal", zero, F.lit(f), F.col(f"record.personal.{f}")) for f in ("name", "email", "phone", "location")], one("summary", zero, F.lit("summary"), F.col("record.summary")))]
    parts.append(F.transform("record.skills", lambda s, i: one("skills", i, F.lit("skill"), s)))
    experience = ("company", "designation", "location", "startDate", "endDate", "current", "description")
    parts.append(F.flatten(F.transform("record.experience", lambda e, i: F.concat(F.array(*[one("experience", i, F.lit(f), e[f], "boolean" if f == "current" else "") for f in experience]), F.coalesce(F.transform(e["technologies"], lambda t, k: one("experience", i, F.concat(F.lit("technology["), k.cast("string"), F.lit("]")), t)), F.array().cast("array<struct<section:string,item_index:bigint,field:string,value:string>>"))))))
    parts.append(F.flatten(F.transform("record.education", lambda e, i: F.array(*[one("education", i, F.lit(f), e[f]) for f in ("institution", "degree", "grade")]))))
    none = F.array().cast("array<struct<section:string,item_index:bigint,field:string,value:string>>")
    every = F.concat(*[F.coalesce(p, none) for p in parts])
    return rows.select("resume_id", F.explode(every).alias("p")).select("resume_id", "p.*").where("value is not null and value <> ''")


def report(rows: DataFrame) -> DataFrame:
    """A plain-text report a record: sections in fixed order, a line a value."""
    sections = ("personal", "summary", "skills", "experience", "education")
    place = F.array_position(F.array(*map(F.lit, sections)), F.col("section"))
    lines = long_form(rows).groupBy("resume_id", "section").agg(place_first(place), F.array_sort(F.collect_list(F.struct("item_index", "field", "value"))).alias("own"))
    lines = lines.withColumn("text", F.concat(F.upper("section"), F.lit("\n"), F.array_join(F.transform("own", lambda x: F.concat(x["field"], F.lit(": "), x["value"])), "\n")))
    return lines.groupBy("resume_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n\n").alias("report"))


def place_first(place: Column) -> Column:
    return F.first(place).alias("place")


def health(spark) -> dict[str, object]:  # noqa: ANN001
    """What the service says of itself: that it runs, and on what."""
    return {"status": "ok", "spark": spark.version, "reusable": list(REUSABLE)}
