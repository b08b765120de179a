"""Citations: what is wrong with one as authored, its normal form and its page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The form of an identifier by citation type, the page of each type, and that of an accession by database.
FORMS = {
    "doi": r"^10\.\d{4,9}/[-._;()/:a-zA-Z0-9]+$",
    "pmid": r"^[1-9]\d{0,8}$",
    "pmcid": r"^PMC\d{1,9}$",
    "accession": r"^[A-Za-z][A-Za-z0-9_.:-]{2,63}$",
    "url": r"^https://[^\s]+$",
}
PAGES = {"doi": "https://doi.org/{id}", "pmid": "https://pubmed.ncbi.nlm.nih.gov/{id}/", "pmcid": "https://www.ncbi.nlm.nih.gov/pmc/articles/{id}/"}
DATABASES = {
    "dbsnp": "https://www.ncbi.nlm.nih.gov/snp/{id}",
    "clinvar": "https://www.ncbi.nlm.nih.gov/clinvar/variation/{id}/",
    "pharmgkb": "https://www.pharmgkb.org/variant/{id}",
    "pgscatalog": "https://www.pgscatalog.org/score/{id}/",
    "omim": "https://www.omim.org/entry/{id}",
    "ensembl": "https://www.ensembl.org/id/{id}",
}


def _by(key: Column, values: dict[str, Column]) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, value in values.items():
        out = out.when(key == name, value)
    return out


def _filled(page: str, identifier: Column) -> Column:
    before, _, after = page.partition("{id}")
    return F.concat(F.lit(before), identifier, F.lit(after))


def well_formed(kind: Column, identifier: Column) -> Column:
    """Whether an identifier has its type's form; false for nulls and unknown types."""
    return F.coalesce(_by(kind, {k: F.when(identifier.rlike(form), F.lit("y")) for k, form in FORMS.items()}).isNotNull(), F.lit(False))


def normal_citations(rows: DataFrame) -> DataFrame:
    """`rows` (type, id, title, database) with n_type, n_id and n_database, as they are kept, and `problem`, the first thing wrong, if any.

    A DOI loses the prefix of its resolver, a PMCID is in upper case. Only accessions name a database, and must.
    """
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    kind, database = F.lower(F.trim("type")), F.when(~blank(F.col("database")), F.trim("database"))
    bare = F.trim("id")
    identifier = F.when(kind == "doi", F.regexp_replace(bare, r"(?i)^(https?://doi\.org/|doi:)", "")).when(kind == "pmcid", F.upper(bare)).otherwise(bare)
    named = rows.withColumns({"n_type": kind, "n_id": identifier, "n_database": database})
    problem = (
        F.when(blank(F.col("type")) | blank(F.col("id")) | blank(F.col("title")), "missing_field")
        .when(~F.col("n_type").isin(*FORMS), "unknown_type")
        .when(~well_formed(F.col("n_type"), F.col("n_id")), "malformed_id")
        .when((F.col("n_type") == "accession") & F.col("n_database").isNull(), "missing_database")
        .when((F.col("n_type") != "accession") & F.col("n_database").isNotNull(), "unexpected_database")
    )
    return named.withColumn("problem", problem)


def citation_page(kind: Column, identifier: Column, database: Column) -> Column:
    """The page of a stored citation, checked anew; null where none is known or the identifier is odd, and never another scheme than https."""
    kind, identifier = F.lower(F.trim(kind)), F.trim(identifier)
    registry = F.regexp_replace(F.lower(F.coalesce(database, F.lit(""))), "[^a-z0-9]+", "")
    pages = {k: _filled(p, identifier) for k, p in PAGES.items()} | {"url": identifier, "accession": _by(registry, {k: _filled(p, identifier) for k, p in DATABASES.items()})}
    return F.when(well_formed(kind, identifier), _by(kind, pages))
