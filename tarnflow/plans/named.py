"""The named queries as join specs over relations with their usual column names."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .spec import Edge, JoinSpec, Relation


def line(edges: DataFrame | list[DataFrame], k: int, src: str = "src", dst: str = "dst") -> JoinSpec:
    """g1.dst = g2.src, ..., gk-1.dst = gk.src."""
    parts = list(edges) if isinstance(edges, list) else [edges] * k
    if k < 2 or len(parts) != k:
        raise ValueError("k >= 2, and one table or k of them")
    return JoinSpec({f"g{i + 1}": Relation(p, (src, dst)) for i, p in enumerate(parts)}, [Edge(f"g{i}", f"g{i + 1}", ((dst, src),)) for i in range(1, k)])


def star(edges: DataFrame | list[DataFrame], k: int, src: str = "src", dst: str = "dst") -> JoinSpec:
    """g1.src = gi.src for all i."""
    parts = list(edges) if isinstance(edges, list) else [edges] * k
    if k < 2 or len(parts) != k:
        raise ValueError("k >= 2, and one table or k of them")
    return JoinSpec({f"g{i + 1}": Relation(p, (src, dst)) for i, p in enumerate(parts)}, [Edge("g1", f"g{i}", ((src, src),)) for i in range(2, k + 1)])


def second(first: DataFrame, own: DataFrame | None) -> DataFrame:
    """A table's second role: its own rows where it arrives as a stream of its own."""
    return first if own is None else own


def qx(store_sales: DataFrame, store_returns: DataFrame, catalog_sales: DataFrame, date_dim: DataFrame, sale=(("ss_item_sk", "sr_item_sk"), ("ss_ticket_number", "sr_ticket_number")), ss_id=None, sr_id=None, cs_id=("cs_item_sk", "cs_order_number"), date_dim2: DataFrame | None = None) -> JoinSpec:
    """date d1 - store_sales - store_returns - catalog_sales - date d2.  sale: the columns that tie a return to its sale; date_dim2: the second role, if it has rows of its own."""
    d1, d2 = Relation(date_dim, ("d_date_sk",)), Relation(second(date_dim, date_dim2), ("d_date_sk",))
    ss, sr = Relation(store_sales, ss_id or tuple(a for a, _ in sale)), Relation(store_returns, sr_id or tuple(b for _, b in sale))
    return JoinSpec(
        {"ss": ss, "d1": d1, "sr": sr, "cs": Relation(catalog_sales, tuple(cs_id)), "d2": d2},
        [
            Edge("ss", "d1", (("ss_sold_date_sk", "d_date_sk"),), key="right"), Edge("sr", "ss", tuple((b, a) for a, b in sale), key="right"),
            Edge("sr", "cs", (("sr_customer_sk", "cs_bill_customer_sk"),)), Edge("cs", "d2", (("cs_sold_date_sk", "d_date_sk"),), key="right"),
        ],
    )


def qy(store_sales: DataFrame, customer: DataFrame, household_demographics: DataFrame, ss_id=("ss_item_sk", "ss_ticket_number"), customer2: DataFrame | None = None, household_demographics2: DataFrame | None = None) -> JoinSpec:
    """store_sales - c1 - hd1 =income= hd2 - c2."""
    return JoinSpec({"ss": Relation(store_sales, tuple(ss_id)), **_people(customer, household_demographics, customer2, household_demographics2)}, _income_edges())


def _people(customer: DataFrame, hd: DataFrame, customer2: DataFrame | None, hd2: DataFrame | None) -> dict[str, Relation]:
    c, h = ("c_customer_sk",), ("hd_demo_sk",)
    return {"c1": Relation(customer, c), "hd1": Relation(hd, h), "hd2": Relation(second(hd, hd2), h), "c2": Relation(second(customer, customer2), c)}


def _income_edges() -> list[Edge]:
    return [
        Edge("ss", "c1", (("ss_customer_sk", "c_customer_sk"),), key="right"), Edge("c1", "hd1", (("c_current_hdemo_sk", "hd_demo_sk"),), key="right"),
        Edge("hd1", "hd2", (("hd_income_band_sk", "hd_income_band_sk"),)), Edge("c2", "hd2", (("c_current_hdemo_sk", "hd_demo_sk"),), key="right"),
    ]


def qz(store_sales: DataFrame, customer: DataFrame, household_demographics: DataFrame, item: DataFrame, ss_id=("ss_item_sk", "ss_ticket_number"), customer2: DataFrame | None = None, household_demographics2: DataFrame | None = None, item2: DataFrame | None = None) -> JoinSpec:
    """qy, and the sold item i1 with every item i2 of its category."""
    i1, i2 = Relation(item, ("i_item_sk",)), Relation(second(item, item2), ("i_item_sk",))
    return JoinSpec(
        {"ss": Relation(store_sales, tuple(ss_id)), "i1": i1, "i2": i2, **_people(customer, household_demographics, customer2, household_demographics2)},
        [Edge("ss", "i1", (("ss_item_sk", "i_item_sk"),), key="right"), Edge("i1", "i2", (("i_category_id", "i_category_id"),)), *_income_edges()],
    )


def q10(message: DataFrame, has_tag: DataFrame, tag: DataFrame, tag_class: DataFrame, person: DataFrame, city: DataFrame, country: DataFrame, knows: DataFrame, has_tag2: DataFrame | None = None, tag2: DataFrame | None = None, person2: DataFrame | None = None) -> JoinSpec:
    """The 11-way tree around messages: two tags, the second one's class, the creator's place and acquaintances."""
    t1, t2 = (Relation(x, ("id",)) for x in (tag, second(tag, tag2)))
    h1, h2 = (Relation(x, ("message_id", "tag_id")) for x in (has_tag, second(has_tag, has_tag2)))
    p1, p2 = (Relation(x, ("id",)) for x in (person, second(person, person2)))
    return JoinSpec(
        {
            "message": Relation(message, ("id",)), "has_tag1": h1, "tag1": t1, "has_tag2": h2, "tag2": t2, "tag_class": Relation(tag_class, ("id",)), "person1": p1,
            "city": Relation(city, ("id",)), "country": Relation(country, ("id",)), "knows": Relation(knows, ("person1_id", "person2_id")), "person2": p2,
        },
        [
            Edge("has_tag1", "message", (("message_id", "id"),)), Edge("has_tag1", "tag1", (("tag_id", "id"),), key="right"),
            Edge("has_tag2", "message", (("message_id", "id"),)), Edge("has_tag2", "tag2", (("tag_id", "id"),), key="right"),
            Edge("tag2", "tag_class", (("type_tag_class_id", "id"),), key="right"), Edge("message", "person1", (("creator_person_id", "id"),)),
            Edge("person1", "city", (("location_city_id", "id"),), key="right"), Edge("city", "country", (("part_of_place_id", "id"),), key="right"),
            Edge("knows", "person1", (("person1_id", "id"),)), Edge("knows", "person2", (("person2_id", "id"),), key="right"),
        ],
    )


#: Which relations of q10 become one: four parts, or three.
Q10_PLAN1 = [["has_tag1", "tag1"], ["has_tag2", "tag2", "tag_class"], ["message"], ["person1", "city", "country", "knows", "person2"]]
Q10_PLAN2 = [["person1", "knows", "person2", "city", "country"], ["message", "has_tag1", "tag1"], ["has_tag2", "tag2", "tag_class"]]
