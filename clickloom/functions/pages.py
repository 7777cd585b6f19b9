"""Page URLs: base path, canonical product and category forms."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_page(page: Column) -> Column:
    """Trimmed page; '/product/<id>?…' loses its query string."""
    page = F.trim(F.coalesce(page, F.lit("")))
    product_id = F.trim(F.regexp_extract(page, r"^/product/([^/?]*)", 1))
    return F.when(product_id != "", F.concat(F.lit("/product/"), product_id)).otherwise(page)


def page_base(page: Column) -> Column:
    """Page family: '/product', '/category', '/search', or the path before '?'."""
    page = F.trim(F.coalesce(page, F.lit("")))
    return (
        F.when(page.startswith("/product/") | page.startswith("/p/"), F.lit("/product"))
        .when(page.startswith("/category/"), F.lit("/category"))
        .when(page.startswith("/search"), F.lit("/search"))
        .otherwise(F.substring_index(page, "?", 1))
    )


def is_product_page(page: Column) -> Column:
    return page.startswith("/p/") | page.contains("/product/")


def pattern_page(page: Column) -> Column:
    """Page item for pattern mining."""
    return (
        F.when(page.contains("/p/"), F.lit("/product"))
        .when(page.contains("/category"), F.lit("/category"))
        .otherwise(F.substring_index(page, "?", 1))
    )


def _set_parameter(page: Column, name: str, value: Column) -> Column:
    """Set one query parameter, keeping the others and their order."""
    path = F.substring_index(page, "?", 1)
    query = F.substring_index(page, "?", -1)
    setting = F.concat(F.lit(name + "="), value)
    parts = F.split(query, "&")
    replaced = F.transform(
        parts, lambda part: F.when(part.startswith(name + "="), setting).otherwise(part)
    )
    missing = ~F.exists(parts, lambda part: part.startswith(name + "="))
    full = F.when(missing, F.concat(replaced, F.array(setting))).otherwise(replaced)
    return F.concat(path, F.lit("?"), F.array_join(full, "&"))


def canonical_product_page(page: Column, product_id: Column, id_length: int | None = None) -> Column:
    """'/p/<slug>?id=<product_id>' when the event names its product.

    ``id_length`` leaves ids of another length as they are.
    """
    usable = F.coalesce(product_id, F.lit("")) != ""
    if id_length is not None:
        usable = usable & (F.length(product_id) == id_length)
    fixed = F.when(page.contains("?"), _set_parameter(page, "id", product_id)).otherwise(
        F.concat(page, F.lit("?id="), product_id)
    )
    return F.when(page.startswith("/p/") & usable, fixed).otherwise(page)


def canonical_category_page(page: Column, category: Column) -> Column:
    """'/category?category=<name>' when the event names its category."""
    usable = F.coalesce(category, F.lit("")) != ""
    fixed = F.when(page.contains("?"), _set_parameter(page, "category", category)).otherwise(
        F.concat(F.lit("/category?category="), category)
    )
    return F.when(page.startswith("/category") & usable, fixed).otherwise(page)


def slug(name: Column) -> Column:
    """URL slug of a product name."""
    dashed = F.regexp_replace(F.lower(F.trim(name)), r"[^a-z0-9]+", "-")
    return F.trim(dashed, F.lit("-"))
