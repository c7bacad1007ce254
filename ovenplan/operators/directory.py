"""Contact and reference lists over parties and their subtypes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ovenplan.functions.labels import EMAIL_TYPES, PHONE_TYPES, decode
from ovenplan.functions.predicates import like_ci

STAFF_COLUMNS = [
    "party_id",
    "first_name",
    "last_name",
    "ssn",
    "is_active",
    "hire_date",
    "street_no",
    "street",
    "city",
    "state",
    "zip",
    "mobile",
]


def full_name(parties: DataFrame, people: DataFrame) -> DataFrame:
    """``party_id, name``: first and last name of a person, else the party's name."""
    p, pe = parties.alias("p"), people.alias("pe")
    name = F.when(
        F.col("pe.party_type") == "i", F.concat("pe.first_name", F.lit(" "), "p.party_name")
    ).otherwise(F.col("p.party_name"))
    return p.join(pe, F.col("p.party_id") == F.col("pe.party_id"), "full").select("p.party_id", name.alias("name"))


def join_party(df: DataFrame, parties: DataFrame, party_id: str, party_type: str) -> DataFrame:
    """Add ``party_name`` by id and type, as one id may be used by both types."""
    named = parties.select(
        F.col("party_id").alias(party_id), F.col("party_type").alias(party_type), F.col("party_name")
    )
    return df.join(named, [party_id, party_type])


def phone_book(phones: DataFrame, parties: DataFrame, people: DataFrame) -> DataFrame:
    """One row per phone of a known party; the three inputs share one partitioning on ``party_id``."""
    return (
        phones.join(full_name(parties, people), "party_id")
        .join(parties.select("party_id", "party_type"), "party_id")
        .select("party_id", "name", "party_type", decode(F.col("phone_type"), PHONE_TYPES).alias("type"), "phone_no")
    )


def sort_phone_book(book: DataFrame) -> DataFrame:
    return book.orderBy("party_id", "type", "phone_no", "name", "party_type")


def phone_search(book: DataFrame, pattern: str) -> DataFrame:
    return book.filter(like_ci(F.col("name"), pattern)).select("name", F.col("type").alias("phone_type"), "phone_no")


def staff_phones(staff: DataFrame, people: DataFrame, book: DataFrame) -> DataFrame:
    """Every staff member with the mobile number, or ``none`` and the first name alone."""
    mobile = book.filter(F.col("type") == "mobile").select("party_id", "name", "phone_no")
    return (
        staff.join(mobile, "party_id", "left")
        .join(people.select("party_id", "first_name"), "party_id")
        .select(
            F.coalesce("name", "first_name").alias("name"),
            "hire_date",
            "is_active",
            F.coalesce("phone_no", F.lit("none")).alias("mobile"),
        )
    )


def email_list(emails: DataFrame, parties: DataFrame, people: DataFrame) -> DataFrame:
    return (
        emails.join(full_name(parties, people), "party_id")
        .join(parties.select("party_id"), "party_id")
        .select("party_id", "name", decode(F.col("email_type"), EMAIL_TYPES).alias("type"), "email")
    )


def staff_list(
    staff: DataFrame,
    people: DataFrame,
    parties: DataFrame,
    book: DataFrame,
    zip_codes: DataFrame,
    mobile_only: bool = False,
) -> DataFrame:
    """Staff with address and phone.

    By default one row per distinct phone of any type, and one for staff without a phone. ``mobile_only`` is the older list:
    mobile phones only, and staff without one are left out.
    """
    numbers = book.select("party_id", "type", F.col("phone_no").alias("mobile"))
    named = join_party(
        staff.join(people.select("party_id", "first_name"), "party_id"), parties, "party_id", "party_type"
    ).withColumnRenamed("party_name", "last_name")
    if mobile_only:
        listed = named.join(numbers.filter(F.col("type") == "mobile"), "party_id")
        return listed.join(zip_codes, "zip").select(*STAFF_COLUMNS)
    listed = named.join(numbers, "party_id", "left")
    return listed.join(zip_codes, "zip").select(*STAFF_COLUMNS).distinct()


def people_list(people: DataFrame, parties: DataFrame) -> DataFrame:
    return people.join(parties.select("party_id", "party_name"), "party_id").select(
        "party_id", "first_name", F.col("party_name").alias("last_name")
    )


def shape_list(product_shapes: DataFrame, products: DataFrame, shapes: DataFrame) -> DataFrame:
    return (
        product_shapes.join(products, "product_id")
        .join(shapes, "shape_id")
        .select(F.col("product_name").alias("product"), F.col("shape_name").alias("shape"), "grams")
    )


def ein_list(ein_numbs: DataFrame, parties: DataFrame) -> DataFrame:
    return join_party(ein_numbs, parties, "party_id", "party_type").select(F.col("party_name").alias("name"), "ein")


def ingredient_list(ingredients: DataFrame, parties: DataFrame) -> DataFrame:
    """Ingredients with their manufacturer (first-generation columns)."""
    return join_party(ingredients, parties, "manufacturer_id", "manufacturer_type").select(
        "ingredient_id",
        F.col("ingredient_name").alias("ingredient"),
        F.col("party_name").alias("manufacturer"),
    )


def saved_list(view: DataFrame, columns: Sequence[str]) -> DataFrame:
    return view.select(*columns)
