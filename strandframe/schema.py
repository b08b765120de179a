"""Labels, limits and the fixed schema of the normalized genotype table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Chromosome labels in biological order and GRCh37 lengths (the pseudo-autosomal label is bounded by X).
LENGTHS = {
    "1": 249250621, "2": 243199373, "3": 198022430, "4": 191154276, "5": 180915260, "6": 171115067, "7": 159138663, "8": 146364022,
    "9": 141213431, "10": 135534747, "11": 135006516, "12": 133851895, "13": 115169878, "14": 107349540, "15": 102531392, "16": 90354753,
    "17": 81195210, "18": 78077248, "19": 59128983, "20": 63025520, "21": 48129895, "22": 51304566, "X": 155270560, "Y": 59373566,
    "PAR": 155270560, "MT": 16569,
}
CHROMS = tuple(LENGTHS)
AUTOSOMES = CHROMS[:22]
#: Vendor codes of the numeric layout, and labels of the letter layout.
NUMERIC_CODES = {**{c: c for c in AUTOSOMES}, "23": "X", "24": "Y", "25": "PAR", "26": "MT"}
LETTER_CODES = {**{c: c for c in AUTOSOMES}, "X": "X", "Y": "Y", "M": "MT", "MT": "MT"}
ALLELES = ("A", "C", "G", "T", "I", "D")
INDELS = ("I", "D")
NO_CALL = "0"
STATUSES = ("called", "hemizygous", "het_haploid", "no_call")

GENOTYPES = T.StructType(
    [
        T.StructField("rsid", T.StringType()),
        T.StructField("chrom", T.StringType()),
        T.StructField("pos_grch37", T.LongType()),
        T.StructField("allele1", T.StringType()),
        T.StructField("allele2", T.StringType()),
        T.StructField("genotype", T.StringType()),
        T.StructField("call_status", T.StringType()),
    ]
)


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def chrom_order(chrom: str = "chrom") -> Column:
    """0 for chromosome 1 up to 25 for MT; null for other labels."""
    return F.try_element_at(literal_map({c: i for i, c in enumerate(CHROMS)}), F.col(chrom))


def validate(df: DataFrame) -> DataFrame:
    """Refuse a frame whose first columns are not the genotype schema, by names, order and types."""
    own = [(f.name, f.dataType) for f in df.schema.fields[: len(GENOTYPES)]]
    if own != [(f.name, f.dataType) for f in GENOTYPES.fields]:
        raise ValueError(f"not a genotype table: {df.schema.simpleString()}")
    return df


def dimension(spark, name: str, values: tuple[str, ...]) -> DataFrame:
    """A row per label with its rank, for counts that keep their zeros."""
    return spark.createDataFrame(list(enumerate(values)), f"rank int, {name} string")
