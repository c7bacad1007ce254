"""Declared tables: columns, keys, defaults, references and domain rules.

Key columns are text (uuids) in the current schema and integers in the first one, so their type is a parameter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

NOW = "now"
UUID = "uuid"
STAMPS = "created timestamp, modified timestamp"
PARTS = "percent_in_sour decimal(18,6), percent_in_poolish decimal(5,2), percent_in_soaker decimal(18,6)"

# Fixed value: months an order may lie ahead.
ORDER_WINDOW_MONTHS = 6


@dataclass(frozen=True)
class Rule:
    """A condition every row must meet. A NULL result passes. ``:as_of`` stands for the planning date."""

    name: str
    condition: str
    value: str


@dataclass(frozen=True)
class Reference:
    """Columns that must be found in a parent table; a row with a NULL among them passes."""

    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


@dataclass(frozen=True)
class Table:
    columns: str
    key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    nullable: tuple[str, ...] = ("created", "modified")
    defaults: dict[str, object] = field(default_factory=dict)
    references: tuple[Reference, ...] = ()
    rules: tuple[Rule, ...] = ()
    touched: bool = False

    def ddl(self, key_type: str = "string") -> str:
        return self.columns.replace("KEY", key_type)

    @property
    def types(self) -> dict[str, str]:
        """Declared type by column; ``KEY`` for keys, whose type is a parameter."""
        return {name: kind for name, kind in re.findall(r"(\w+) (\w+(?:\([^)]*\))?)", self.columns)}

    @property
    def names(self) -> list[str]:
        return list(self.types)

    @property
    def not_null(self) -> list[str]:
        return [name for name in self.names if name not in self.nullable]


def one_of(name: str, column: str, values: str) -> Rule:
    return Rule(name, f"{column} IN ({values})", column)


def _party(column: str, type_column: str) -> Reference:
    return Reference((column, type_column), "parties", ("party_id", "party_type"))


def _to(column: str, parent: str) -> Reference:
    return Reference((column,), parent, (column,))


def _part_rules() -> tuple[Rule, ...]:
    rules = []
    for part in ("sour", "poolish", "soaker"):
        column = f"percent_in_{part}"
        rules.append(Rule(f"{column}_positive", f"{column} >= 0", column))
        rules.append(Rule(f"{column}_max_100", f"{column} <= 100", column))
    return tuple(rules)


# Rule names, conditions and code lists.
_PERSON = one_of("party_type_is_i", "party_type", "'i'")
_ORGANIZATION = one_of("party_type_is_o", "party_type", "'o'")
_IO = one_of("io_i_or_o", "io", "'i', 'o'")
_MIO = one_of("mio_i_or_o", "mio", "'i', 'o'")
_SIO = one_of("sio_i_or_o", "sio", "'i', 'o'")
_DOW = one_of("dow_in_0_thru_6", "day_of_week", "0, 1, 2, 3, 4, 5, 6")
_DOW_V1 = one_of("dow_in_1_thru_7", "day_of_week", "1, 2, 3, 4, 5, 6, 7")
_AMT = Rule("amt_greater_than_0", "amt > 0", "amt")
_BP = Rule("bp_positive", "bakers_percent > 0", "bakers_percent")
_DAY_NAMES = one_of("dow_names_3_letter_abr", "dow_names", "'Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'")
_WITHIN = f":as_of, {ORDER_WINDOW_MONTHS})"

TABLES: dict[str, Table] = {
    "parties": Table(
        f"party_id KEY, party_type string, party_name string, {STAMPS}",
        key=("party_id", "party_type"),
        defaults={"party_id": UUID, "created": NOW, "modified": NOW},
        rules=(one_of("party_type_i_or_o", "party_type", "'i', 'o'"),),
        touched=True,
    ),
    "people_st": Table(
        f"party_id KEY, party_type string, first_name string, {STAMPS}",
        key=("party_id",),
        defaults={"party_type": "i", "created": NOW, "modified": NOW},
        references=(_party("party_id", "party_type"),),
        rules=(_PERSON,),
        touched=True,
    ),
    "zip_codes": Table(
        "zip string, city string, state string",
        key=("zip",),
        rules=(
            Rule("zip_length_5", "length(zip) = 5", "zip"),
            Rule("st_length_2", "length(state) = 2", "state"),
        ),
    ),
    "staff_st": Table(
        "party_id KEY, party_type string, ssn string, hire_date date, is_active boolean, street_no string, "
        f"street string, zip string, {STAMPS}",
        key=("party_id",),
        defaults={"party_type": "i", "created": NOW, "modified": NOW},
        references=(_party("party_id", "party_type"), _to("party_id", "people_st"), _to("zip", "zip_codes")),
        rules=(
            Rule("hire_date_after_1970", "hire_date > DATE'1970-01-01'", "hire_date"),
            Rule("hire_date_within_next_mon", "hire_date < add_months(:as_of, 1)", "hire_date"),
            Rule("ssn_length_11", "length(ssn) <= 11", "ssn"),
            Rule("zip_length_5", "length(zip) = 5", "zip"),
            _PERSON,
        ),
    ),
    "organization_st": Table(
        "party_id KEY, party_type string, org_type string",
        key=("party_id",),
        defaults={"party_type": "o"},
        references=(_party("party_id", "party_type"),),
        rules=(_ORGANIZATION, one_of("check_org_in_list", "org_type", "'b', 'c', 'n', 'g'")),
    ),
    "ein_numbs": Table(
        "ein string, party_id KEY, party_type string",
        key=("ein",),
        nullable=("party_id",),
        defaults={"party_type": "o"},
        references=(_party("party_id", "party_type"),),
        rules=(_ORGANIZATION,),
    ),
    "phones": Table(
        f"party_id KEY, phone_type string, phone_no string, {STAMPS}",
        key=("party_id", "phone_type"),
        unique=(("phone_no",),),
        defaults={"phone_type": "m", "created": NOW, "modified": NOW},
        rules=(one_of("phone_type_from_list", "phone_type", "'w', 'h', 'f', 'b', 'm', 'e'"),),
        touched=True,
    ),
    "emails": Table(
        f"party_id KEY, email_type string, email string, {STAMPS}",
        key=("party_id", "email_type"),
        unique=(("email",),),
        defaults={"email_type": "p", "created": NOW, "modified": NOW},
        rules=(one_of("email_type_from_list", "email_type", "'w', 'b', 'p'"),),
    ),
    "ingredients": Table(
        f"ingredient_id KEY, ingredient_name string, is_flour boolean, {STAMPS}",
        key=("ingredient_id",),
        defaults={"ingredient_id": UUID, "created": NOW, "modified": NOW},
        touched=True,
    ),
    "ingredient_costs": Table(
        "ingredient_id KEY, maker_id KEY, mio string, seller_id KEY, sio string, cost decimal(10,5), "
        f"grams decimal(18,6), {STAMPS}",
        key=("ingredient_id", "maker_id", "seller_id"),
        defaults={"created": NOW, "modified": NOW},
        references=(_to("ingredient_id", "ingredients"), _party("maker_id", "mio"), _party("seller_id", "sio")),
        rules=(_MIO, _SIO),
        touched=True,
    ),
    "cost_change_log": Table(
        "ingredient_id KEY, maker_id KEY, mio string, seller_id KEY, sio string, old_cost decimal(10,5), "
        "new_cost decimal(10,5), old_grams decimal(18,6), new_grams decimal(18,6), change_time timestamp",
        key=("ingredient_id", "maker_id", "seller_id", "change_time"),
        defaults={"change_time": NOW},
        references=(_to("ingredient_id", "ingredients"), _party("maker_id", "mio"), _party("seller_id", "sio")),
        rules=(_MIO, _SIO),
    ),
    "products": Table(
        "product_id KEY, product_name string, lead_time_days int, is_dough boolean",
        key=("product_id",),
        unique=(("product_name",),),
        defaults={"product_id": UUID},
        rules=(
            Rule("lead_time_not_negative", "lead_time_days >= 0", "lead_time_days"),
            Rule("lead_time_less_than_8", "lead_time_days < 8", "lead_time_days"),
        ),
    ),
    "product_instructions": Table(
        "product_id KEY, sequence int, directions string",
        references=(_to("product_id", "products"),),
        rules=(Rule("sequence_positive", "sequence >= 0", "sequence"),),
    ),
    "shapes": Table(
        "shape_id KEY, shape_name string",
        key=("shape_id",),
        unique=(("shape_name",),),
        defaults={"shape_id": UUID},
    ),
    "product_shapes": Table(
        "product_id KEY, shape_id KEY, grams int",
        key=("product_id", "shape_id"),
        references=(_to("product_id", "products"), _to("shape_id", "shapes")),
        rules=(
            Rule("grams_greater_than_0", "grams > 0", "grams"),
            Rule("grams_less_than_3000", "grams < 3000", "grams"),
        ),
    ),
    "product_ingredients": Table(
        f"product_id KEY, ingredient_id KEY, bakers_percent decimal(5,2), {PARTS}, {STAMPS}",
        key=("product_id", "ingredient_id"),
        nullable=(),
        defaults={
            "percent_in_sour": 0,
            "percent_in_poolish": 0,
            "percent_in_soaker": 0,
            "created": NOW,
            "modified": NOW,
        },
        references=(_to("product_id", "products"), _to("ingredient_id", "ingredients")),
        rules=(_BP, *_part_rules()),
        touched=True,
    ),
    "product_ingredients_changes": Table(
        "product_id KEY, old_ingredient_id KEY, new_ingredient_id KEY, old_bakers_percent decimal(5,2), "
        f"new_bakers_percent decimal(5,2), {PARTS}, {STAMPS}",
        key=("product_id", "new_ingredient_id", "created"),
        nullable=("modified",),
        defaults={"created": NOW, "modified": NOW},
        references=(
            _to("product_id", "products"),
            Reference(("old_ingredient_id",), "ingredients", ("ingredient_id",)),
            Reference(("new_ingredient_id",), "ingredients", ("ingredient_id",)),
        ),
        rules=(Rule("bp_positive", "new_bakers_percent > 0", "new_bakers_percent"), *_part_rules()),
    ),
    "dough_mods": Table(
        f"mod_name string, product_id KEY, ingredient_id KEY, bakers_percent decimal(5,2), {PARTS}, {STAMPS}",
        key=("mod_name", "product_id", "ingredient_id"),
        defaults={"created": NOW, "modified": NOW},
        references=(_to("product_id", "products"), _to("ingredient_id", "ingredients")),
        rules=(_BP, *_part_rules()),
        touched=True,
    ),
    "special_orders": Table(
        f"delivery_date date, customer_id KEY, io string, product_id KEY, shape_id KEY, amt int, {STAMPS}",
        key=("delivery_date", "customer_id", "product_id", "shape_id", "created"),
        nullable=("modified",),
        defaults={"created": NOW, "modified": NOW},
        references=(_to("product_id", "products"), _to("shape_id", "shapes"), _party("customer_id", "io")),
        rules=(
            _IO,
            Rule("delivery_date_present_or_future", "delivery_date >= :as_of", "delivery_date"),
            Rule("delivery_date_in_next_6_mons", f"delivery_date < add_months({_WITHIN}", "delivery_date"),
            _AMT,
        ),
        touched=True,
    ),
    "days_of_week": Table(
        "dow_id smallint, dow_names string",
        key=("dow_id",),
        unique=(("dow_names",),),
        rules=(Rule("dow_id_between_0_and_6", "dow_id >= 0 AND dow_id <= 6", "dow_id"), _DAY_NAMES),
    ),
    "standing_orders": Table(
        f"day_of_week smallint, customer_id KEY, io string, product_id KEY, shape_id KEY, amt int, {STAMPS}",
        key=("day_of_week", "customer_id", "product_id", "shape_id"),
        defaults={"created": NOW, "modified": NOW},
        references=(
            Reference(("day_of_week",), "days_of_week", ("dow_id",)),
            _to("product_id", "products"),
            _to("shape_id", "shapes"),
            _party("customer_id", "io"),
        ),
        rules=(_DOW, _IO, _AMT),
        touched=True,
    ),
    "standing_change_log": Table(
        "old_day_of_week smallint, new_day_of_week smallint, customer_id KEY, io string, product_id KEY, "
        "shape_id KEY, old_amt int, new_amt int, change_time timestamp",
        key=("new_day_of_week", "customer_id", "product_id", "shape_id", "change_time"),
        defaults={"change_time": NOW},
        references=(
            Reference(("old_day_of_week",), "days_of_week", ("dow_id",)),
            Reference(("new_day_of_week",), "days_of_week", ("dow_id",)),
            _to("product_id", "products"),
            _to("shape_id", "shapes"),
            _party("customer_id", "io"),
        ),
        rules=(one_of("dow_in_0_thru_6", "new_day_of_week", "0, 1, 2, 3, 4, 5, 6"), _IO),
    ),
    "tmp_chng": Table(
        "day_of_week smallint, customer_id KEY, product_id KEY, shape_id KEY, start_date date, resume_date date, "
        f"percent_multiplier decimal(4,1), {STAMPS}",
        key=("day_of_week", "customer_id", "product_id", "shape_id", "start_date"),
        nullable=("resume_date", "created", "modified"),
        defaults={"created": NOW, "modified": NOW},
        references=(
            _to("product_id", "products"),
            _to("shape_id", "shapes"),
            Reference(
                ("day_of_week", "customer_id", "product_id", "shape_id"),
                "standing_orders",
                ("day_of_week", "customer_id", "product_id", "shape_id"),
            ),
        ),
        rules=(
            _DOW,
            Rule(
                "start_date_in_next_6_mos",
                f"start_date >= :as_of AND start_date < add_months({_WITHIN}",
                "start_date",
            ),
            Rule(
                "resume_in_next_6_mos",
                f"resume_date >= :as_of AND resume_date < add_months({_WITHIN}",
                "resume_date",
            ),
            Rule("resume_after_start", "resume_date > start_date", "resume_date"),
            Rule("multiplier_not_negative", "percent_multiplier >= 0", "percent_multiplier"),
        ),
        touched=True,
    ),
}

# The first generation of the schema, where it differs: integer keys, doughs, weekdays 1 to 7 with Sunday last, holds.
V1_STAMP = "order_created_at timestamp"
_TO_DOUGH = _to("dough_id", "doughs")
_V1_CUSTOMER = one_of("customer_type_i_or_o", "customer_type", "'i', 'o'")


def _max_length(column: str, length: int) -> Rule:
    return Rule(f"{column}_length_{length}", f"length({column}) <= {length}", column)


TABLES_V1: dict[str, Table] = {
    "parties": Table(
        "party_id KEY, party_type string, party_name string",
        key=("party_id", "party_type"),
        rules=(one_of("party_type_i_or_o", "party_type", "'i', 'o'"), _max_length("party_name", 80)),
    ),
    "people_st": Table(
        "party_id KEY, party_type string, first_name string",
        key=("party_id",),
        defaults={"party_type": "i"},
        references=(_party("party_id", "party_type"),),
        rules=(_PERSON, _max_length("first_name", 25)),
    ),
    "zip_codes": Table(
        "zip string, city string, state string",
        key=("zip",),
        rules=(_max_length("zip", 5), _max_length("city", 70), _max_length("state", 2)),
    ),
    "staff_st": Table(
        "party_id KEY, party_type string, ssn string, hire_date date, is_active boolean, street_no string, "
        "street string, zip string",
        key=("party_id",),
        defaults={"party_type": "i"},
        references=(_party("party_id", "party_type"), _to("party_id", "people_st"), _to("zip", "zip_codes")),
        rules=(_PERSON, _max_length("ssn", 11), _max_length("street_no", 12), _max_length("street", 30)),
    ),
    "organization_st": Table(
        "party_id KEY, party_type string, org_type string",
        key=("party_id",),
        defaults={"party_type": "o"},
        references=(_party("party_id", "party_type"),),
        rules=(_ORGANIZATION, one_of("check_org_in_list", "org_type", "'b', 'n', 'g'")),
    ),
    "ein_numbs": Table(
        "party_id KEY, party_type string, ein string",
        key=("party_id",),
        unique=(("ein",),),
        defaults={"party_type": "o"},
        references=(_party("party_id", "party_type"),),
        rules=(_ORGANIZATION, _max_length("ein", 11)),
    ),
    "phones": Table(
        "party_id KEY, phone_type string, phone_no string",
        key=("party_id", "phone_type"),
        unique=(("phone_no",),),
        defaults={"phone_type": "m"},
        rules=(
            one_of("phone_type_from_list", "phone_type", "'w', 'h', 'f', 'b', 'm', 'e'"),
            _max_length("phone_no", 25),
        ),
    ),
    "ingredients": Table(
        "ingredient_id KEY, ingredient_name string, manufacturer_id bigint, manufacturer_type string, "
        "is_flour boolean",
        key=("ingredient_id",),
        references=(_party("manufacturer_id", "manufacturer_type"),),
        rules=(
            one_of("manufacturer_type_i_or_o", "manufacturer_type", "'i', 'o'"),
            _max_length("ingredient_name", 80),
        ),
    ),
    "doughs": Table(
        "dough_id KEY, dough_name string, lead_time_days int",
        key=("dough_id",),
        unique=(("dough_name",),),
        rules=(_max_length("dough_name", 70),),
    ),
    "shapes": Table(
        "shape_id KEY, shape_name string",
        key=("shape_id",),
        unique=(("shape_name",),),
        rules=(_max_length("shape_name", 70),),
    ),
    "dough_shapes": Table(
        "dough_id KEY, shape_id KEY, ds_grams int",
        key=("dough_id", "shape_id"),
        references=(_TO_DOUGH, _to("shape_id", "shapes")),
    ),
    "dough_ingredients": Table(
        f"dough_id KEY, ingredient_id KEY, bakers_percent decimal(5,2), {PARTS}",
        key=("dough_id", "ingredient_id"),
        references=(_TO_DOUGH, _to("ingredient_id", "ingredients")),
    ),
    "special_orders": Table(
        "special_order_id KEY, delivery_date date, customer_id KEY, customer_type string, dough_id KEY, "
        f"shape_id KEY, amt int, {V1_STAMP}",
        key=("special_order_id",),
        nullable=("order_created_at",),
        defaults={"order_created_at": NOW},
        references=(_TO_DOUGH, _to("shape_id", "shapes"), _party("customer_id", "customer_type")),
        rules=(_V1_CUSTOMER,),
    ),
    "days_of_week": Table(
        "dow_id smallint, dow_names string",
        key=("dow_id",),
        rules=(Rule("dow_id_between_1_and_7", "dow_id > 0 AND dow_id <= 7", "dow_id"), _DAY_NAMES),
    ),
    "standing_orders": Table(
        "day_of_week smallint, customer_id KEY, customer_type string, dough_id KEY, shape_id KEY, amt int, "
        f"{V1_STAMP}",
        key=("day_of_week", "customer_id", "dough_id", "shape_id"),
        nullable=("order_created_at",),
        defaults={"order_created_at": NOW},
        references=(
            Reference(("day_of_week",), "days_of_week", ("dow_id",)),
            _TO_DOUGH,
            _to("shape_id", "shapes"),
            _party("customer_id", "customer_type"),
        ),
        rules=(_DOW_V1, _V1_CUSTOMER),
    ),
    "holds": Table(
        "hold_id KEY, day_of_week smallint, customer_id KEY, dough_id KEY, shape_id KEY, start_date date, "
        "resume_date date, decrease_percent int",
        key=("hold_id",),
        nullable=("resume_date",),
        references=(
            _TO_DOUGH,
            _to("shape_id", "shapes"),
            Reference(
                ("day_of_week", "customer_id", "dough_id", "shape_id"),
                "standing_orders",
                ("day_of_week", "customer_id", "dough_id", "shape_id"),
            ),
        ),
        rules=(
            _DOW_V1,
            Rule(
                "decrease_percent_0_to_100",
                "decrease_percent <= 100 AND decrease_percent >= 0",
                "decrease_percent",
            ),
        ),
    ),
}

# First-generation table and column names -> the current ones, which the operators use.
V1_TABLE_NAMES = {"doughs": "products", "dough_shapes": "product_shapes", "dough_ingredients": "product_ingredients"}
V1_COLUMN_NAMES = {
    "dough_id": "product_id",
    "dough_name": "product_name",
    "ds_grams": "grams",
    "customer_type": "io",
    "order_created_at": "created",
}
