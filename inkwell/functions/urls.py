"""Paths and download addresses of publications, and checks of addresses, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(x: Column | str) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def epodoc_path(constituent: str, reference_type: Column, lookup_number: Column) -> Column:
    return F.concat(F.lit("/published-data/"), reference_type, F.lit("/epodoc/"), F.url_encode(lookup_number), F.lit(f"/{constituent}"))


def docdb_path(constituent: str, reference_type: Column, country: Column, number: Column, kind: Column) -> Column:
    """Null where the kind is missing: this form needs it."""
    id_ = F.concat_ws(".", F.url_encode(country), F.url_encode(number), F.url_encode(kind))
    return F.when(F.coalesce(kind, F.lit("")) != "", F.concat(F.lit("/published-data/"), reference_type, F.lit("/docdb/"), id_, F.lit(f"/{constituent}")))


def search_path(number: Column) -> Column:
    return F.concat(F.lit("/published-data/search/biblio?q=pn%3D"), F.url_encode(number))


def register_path(reference_type: Column, country: Column, number: Column) -> Column:
    return F.concat(F.lit("/register/"), reference_type, F.lit("/epodoc/"), country, number, F.lit("/biblio"))


def fulltext_path(constituent: str, lookup_number: Column) -> Column:
    """Path of the description, the claims or the images of a publication."""
    return F.concat(F.lit("/published-data/publication/epodoc/"), lookup_number, F.lit(f"/{constituent}"))


def family_path(country: Column, number: Column, kind: Column) -> Column:
    return F.concat(F.lit("/family/publication/docdb/"), country, F.lit("."), number, F.lit("."), F.coalesce(kind, F.lit("")), F.lit("/biblio"))


def candidate_paths(reference_type: Column, lookup_number: Column, country: Column, number: Column, kind: Column) -> Column:
    """Distinct paths in the order in which they are tried."""
    full = F.concat(country, number)
    paths = F.array(epodoc_path("biblio", reference_type, lookup_number), docdb_path("biblio", reference_type, country, number, kind), search_path(F.concat(full, F.coalesce(kind, F.lit("")))), search_path(full))
    return F.array_distinct(F.filter(paths, lambda p: p.isNotNull()))


def publication_url(base: str, country: Column, number: Column, kind: Column, extension: str) -> Column:
    """`{country}{number}NW{kind}/document.{extension}` below `base`; null if a part is missing."""
    known = (F.coalesce(country, F.lit("")) != "") & (F.coalesce(number, F.lit("")) != "") & (F.coalesce(kind, F.lit("")) != "")
    return F.when(known, F.concat(F.lit(base.rstrip("/") + "/"), country, number, F.lit("NW"), kind, F.lit(f"/document.{extension}")))


def allowed(url: Column, hosts: list[str]) -> Column:
    """Whether an address is https, without user, on one of the hosts and its usual port."""
    good = (F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & F.try_parse_url(url, F.lit("HOST")).isin(*hosts) & F.try_parse_url(url, F.lit("USERINFO")).isNull()
    return F.coalesce(good & ~F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit("")).rlike(r":(?!443$)\d+$"), F.lit(False))


def object_path(source: Column, number: Column, sha256: Column, filename: Column) -> Column:
    from inkwell.functions.text import safe_filename

    return F.concat(source, F.lit("/"), number, F.lit("/"), F.substring(sha256, 1, 16), F.lit("-"), safe_filename(filename))
