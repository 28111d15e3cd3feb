"""The five targets of the public catalog: courses, books, doctors, categories and levels.

Levels are school stages and college stages as one table (type, id). What isn't public is no part of any target: courses
and books that aren't published, users that are no doctors, categories and levels that aren't active. A category has the
school stage that it names, else its college stage. Children reach a target through what is published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import Target

# What a filter may name, and the texts that are searched.
TITLES = {"title": "text", "subtitle": "text", "description": "text", "language": "text"}
COURSES = {**TITLES, "academic_year": "number", "course_level": "text"}
USERS, CATEGORIES = {"name": "text"}, {"name_en": "text", "name_ar": "text", "slug": "text"}
LEVELS = {"type": "text", "name_en": "text", "name_ar": "text", "group_name": "text", "year_number": "number"}
LEVEL = ["type", "id"]


def levels(stages: DataFrame, colleges: DataFrame) -> DataFrame:
    """type, id, names, group_name, year_number and display_order of active school and college stages."""
    cut = lambda rows, kind, group: rows.filter("is_active").select(F.lit(kind).alias("type"), "id", "name_en", "name_ar", F.col(group).alias("group_name"), "year_number", "display_order")
    return cut(stages, "pre_college", "stage").unionByName(cut(colleges, "college", "faculty"))


def _levelled(categories: DataFrame, known: DataFrame) -> DataFrame:
    """Active categories with the level they stand at, as a struct."""
    level = lambda kind: known.filter(F.col("type") == kind).select(F.col("id").alias(f"_{kind}"), F.struct("type", "id", "name_en", "name_ar", "group_name", "year_number").alias(f"_of_{kind}"))
    out = categories.filter("is_active").join(level("pre_college"), F.col("pre_college_stage_id") == F.col("_pre_college"), "left").join(level("college"), F.col("college_stage_id") == F.col("_college"), "left")
    return out.withColumn("level", F.coalesce("_of_pre_college", "_of_college")).drop("_pre_college", "_college", "_of_pre_college", "_of_college")


def _count(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias(name))


def _counted(rows: DataFrame, key: Column, counts: list[DataFrame]) -> DataFrame:
    for c in counts:
        name = c.columns[-1]
        rows = rows.join(c, key == F.col("_k"), "left").drop("_k").withColumn(name, F.coalesce(name, F.lit(0)))
    return rows


def targets(courses: DataFrame, books: DataFrame, users: DataFrame, categories: DataFrame, stages: DataFrame, colleges: DataFrame) -> dict[str, Target]:
    """courses, books: id, doctor_id, category_id, status, published_at, TITLES (courses: academic_year, course_level); users: id, name,
    role, created_at; categories: id, names, slug, parent_id, display_order, is_active, created_at, pre_college_stage_id,
    college_stage_id; stages and colleges: id, names, stage or faculty, year_number, display_order, is_active."""
    known, doctors = levels(stages, colleges), users.filter("role = 'doctor'")
    placed = _levelled(categories, known)
    out_courses, out_books = (t.filter("status = 'published'") for t in (courses, books))
    items = out_courses.select("doctor_id", "category_id").unionByName(out_books.select("doctor_id", "category_id"))
    flat = [F.col(f"level.{c}").alias(f"level_{c}") for c in (*LEVEL, "name_en", "name_ar", "group_name", "year_number")]
    renamed = lambda columns, head: {f"{head}_{c}": k for c, k in columns.items()}
    level_columns = renamed(LEVELS, "level")

    def publications(rows: DataFrame, columns: dict[str, str]) -> Target:
        named = rows.join(doctors.select(F.col("id").alias("doctor_id"), F.col("name").alias("doctor_name")), "doctor_id")
        of = placed.select(F.col("id").alias("category_id"), F.col("name_en").alias("category_name_en"), F.col("name_ar").alias("category_name_ar"), F.col("slug").alias("category_slug"), *flat)
        newest = [F.desc_nulls_last("published_at"), F.desc("id")]
        allowed = {**columns, **renamed(USERS, "doctor"), **renamed(CATEGORIES, "category"), **level_columns}
        return Target(named.join(of, "category_id", "left"), "id", allowed, text=["title", "subtitle", "description"], orders={"relevance": [F.asc_nulls_last("title")], "newest": newest, "position": [F.asc_nulls_last("title")]})

    doctor_rows = _counted(doctors.select("id", "name", "created_at"), F.col("id"), [_count(out_courses, "doctor_id", "courses"), _count(out_books, "doctor_id", "books")])
    category_rows = _counted(placed.select("id", "name_en", "name_ar", "slug", "parent_id", "display_order", "created_at", *flat), F.col("id"), [_count(out_courses, "category_id", "courses"), _count(out_books, "category_id", "books")])
    at_level = placed.filter("pre_college_stage_id IS NOT NULL OR college_stage_id IS NOT NULL")
    # a category of both stages counts at both
    both = lambda rows: rows.withColumn("_l", F.explode(F.array_compact(F.array(F.when(F.col("pre_college_stage_id").isNotNull(), F.struct(F.lit("pre_college").alias("type"), F.col("pre_college_stage_id").alias("id"))), F.when(F.col("college_stage_id").isNotNull(), F.struct(F.lit("college").alias("type"), F.col("college_stage_id").alias("id"))))))).withColumns({"_type": F.col("_l.type"), "_level": F.col("_l.id")}).drop("_l")
    categories_at = both(at_level)
    through = categories_at.select("_type", "_level", F.col("id").alias("category_id"))
    level_rows = known
    for rows, name in ((through, "categories"), (through.join(out_courses.select("category_id"), "category_id"), "courses"), (through.join(out_books.select("category_id"), "category_id"), "books")):
        n = rows.groupBy(F.col("_type").alias("type"), F.col("_level").alias("id")).agg(F.count(F.lit(1)).alias(name))
        level_rows = level_rows.join(n, LEVEL, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    place = [F.col("type"), F.asc_nulls_last("display_order"), F.asc_nulls_last("year_number")]
    reached = items.join(placed.select(F.col("id").alias("category_id"), "name_en", "name_ar", "slug", F.col("level").alias("_level")), "category_id")
    level_of = reached.select("doctor_id", "_level.*")
    return {
        "courses": publications(out_courses, COURSES),
        "books": publications(out_books, TITLES),
        "users": Target(
            doctor_rows, "id", USERS, {"courses": (out_courses, "doctor_id", COURSES), "books": (out_books, "doctor_id", TITLES), "categories": (reached, "doctor_id", CATEGORIES), "educational_levels": (level_of, "doctor_id", LEVELS)},
            text=["name"], orders={"relevance": [F.asc_nulls_last("name")], "newest": [F.desc("created_at"), F.desc("id")], "position": [F.asc_nulls_last("name")]},
        ),
        "categories": Target(
            category_rows, "id", {**CATEGORIES, **level_columns}, {"courses": (out_courses, "category_id", COURSES), "books": (out_books, "category_id", TITLES), "users": (items.join(doctors.select(F.col("id").alias("doctor_id"), "name"), "doctor_id"), "category_id", USERS)},
            text=["name_en", "name_ar"], orders={"relevance": [F.asc_nulls_last("display_order"), F.asc_nulls_last("name_en")], "newest": [F.desc("created_at"), F.desc("id")], "position": [F.asc_nulls_last("display_order"), F.asc_nulls_last("name_en")]},
        ),
        "educational_levels": Target(
            level_rows, LEVEL, LEVELS,
            {"categories": (categories_at, ["_type", "_level"], CATEGORIES), "courses": (through.join(out_courses, "category_id"), ["_type", "_level"], COURSES), "books": (through.join(out_books, "category_id"), ["_type", "_level"], TITLES), "users": (through.join(items, "category_id").join(doctors.select(F.col("id").alias("doctor_id"), "name"), "doctor_id"), ["_type", "_level"], USERS)},
            text=["name_en", "name_ar", "group_name"], orders={"relevance": place, "newest": [F.col("type"), F.desc("id")], "position": place},
        ),
    }
