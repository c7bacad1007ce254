from __future__ import annotations

import datetime as dt

import pytest

from ovenplan.operators import directory
from tests.conftest import make, rows

HIRED = dt.date(2019, 10, 1)


@pytest.fixture(scope="module")
def people(spark):
    """Three persons and two organizations; id 9 is used by a person and an organization."""
    parties = [("1", "i", "Lark"), ("2", "i", "Bar"), ("3", "i", "Latte"), ("4", "o", "Cobble Works"), ("9", "o", "Mill"), ("9", "i", "Miller")]
    first = [("1", "Ivo"), ("2", "Foo"), ("3", "Moka-Choka"), ("8", "Nobody")]
    phones = [("1", "m", "555-1212"), ("1", "w", "608-555-0000"), ("4", "b", "608-555-0147"), ("2", "m", "608-555-2222"), ("2", "x", "608-555-1234"), ("7", "m", "orphan")]
    return {
        "parties": make(spark, "parties", [dict(party_id=i, party_type=t, party_name=n) for i, t, n in parties]),
        "people": make(spark, "people_st", [dict(party_id=i, party_type="i", first_name=n) for i, n in first]),
        "phones": make(spark, "phones", [dict(party_id=i, phone_type=t, phone_no=n) for i, t, n in phones]),
        "emails": make(
            spark,
            "emails",
            [dict(party_id="1", email_type="p", email="a@example.org"), dict(party_id="4", email_type="w", email="b@example.org")],
        ),
        "zips": make(spark, "zip_codes", [dict(zip="53705", city="Madison", state="WI")]),
        "staff": make(
            spark,
            "staff_st",
            [
                dict(
                    party_id=i,
                    party_type="i",
                    ssn=f"s{i}",
                    hire_date=HIRED,
                    is_active=True,
                    street_no="1",
                    street="Barlow St",
                    zip=z,
                )
                for i, z in (("1", "53705"), ("2", "53705"), ("3", "53705"), ("9", "00000"))
            ],
        ),
    }


@pytest.fixture(scope="module")
def book(people):
    return directory.phone_book(people["phones"], people["parties"], people["people"])


def test_full_name_keeps_both_sides(people):
    assert rows(directory.full_name(people["parties"], people["people"])) == sorted(
        [
            ("1", "Ivo Lark"),
            ("2", "Foo Bar"),
            ("3", "Moka-Choka Latte"),
            ("4", "Cobble Works"),
            ("9", "Mill"),
            ("9", "Miller"),
            (None, None),
        ],
        key=repr,
    )


def test_phone_book(book):
    assert rows(book) == sorted(
        [
            ("1", "Ivo Lark", "i", "mobile", "555-1212"),
            ("1", "Ivo Lark", "i", "work", "608-555-0000"),
            ("2", "Foo Bar", "i", "mobile", "608-555-2222"),
            ("2", "Foo Bar", "i", None, "608-555-1234"),
            ("4", "Cobble Works", "o", "business", "608-555-0147"),
        ],
        key=repr,
    )
    assert [r["type"] for r in directory.sort_phone_book(book).collect()] == ["mobile", "work", None, "mobile", "business"]


def test_phone_search(book):
    assert rows(directory.phone_search(book, "COBB%")) == [("Cobble Works", "business", "608-555-0147")]


def test_staff_phones(people, book):
    assert rows(directory.staff_phones(people["staff"], people["people"], book)) == [
        ("Foo Bar", HIRED, True, "608-555-2222"),
        ("Ivo Lark", HIRED, True, "555-1212"),
        ("Moka-Choka", HIRED, True, "none"),
    ]


def test_email_list(people):
    assert rows(directory.email_list(people["emails"], people["parties"], people["people"])) == [
        ("1", "Ivo Lark", "personal", "a@example.org"),
        ("4", "Cobble Works", "work", "b@example.org"),
    ]


def test_staff_lists(people, book):
    args = (people["staff"], people["people"], people["parties"], book, people["zips"])
    everyone = directory.staff_list(*args)
    assert rows(everyone.select("party_id", "last_name", "city", "mobile")) == [
        ("1", "Lark", "Madison", "555-1212"),
        ("1", "Lark", "Madison", "608-555-0000"),
        ("2", "Bar", "Madison", "608-555-1234"),
        ("2", "Bar", "Madison", "608-555-2222"),
        ("3", "Latte", "Madison", None),
    ]
    older = directory.staff_list(*args, mobile_only=True)
    assert rows(older.select("party_id", "mobile")) == [("1", "555-1212"), ("2", "608-555-2222")]
    assert directory.saved_list(everyone, directory.STAFF_COLUMNS).columns == directory.STAFF_COLUMNS


def test_composite_key_tells_types_apart(spark, people):
    eins = make(spark, "ein_numbs", [dict(ein="01-2", party_id="9", party_type="o")])
    assert rows(directory.ein_list(eins, people["parties"])) == [("Mill", "01-2")]
    makers = spark.createDataFrame(
        [(1, "rye", "9", "o"), (2, "oil", "9", "i")],
        "ingredient_id int, ingredient_name string, manufacturer_id string, manufacturer_type string",
    )
    assert rows(directory.ingredient_list(makers, people["parties"])) == [(1, "rye", "Mill"), (2, "oil", "Miller")]


def test_people_and_shape_lists(people, bakery):
    assert rows(directory.people_list(people["people"], people["parties"])) == [
        ("1", "Ivo", "Lark"),
        ("2", "Foo", "Bar"),
        ("3", "Moka-Choka", "Latte"),
    ]
    shapes = directory.shape_list(bakery["product_shapes"], bakery["products"], bakery["shapes"])
    assert ("pizza dough", '16" pizza', 400) in rows(shapes)
