"""The tables of an index."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, MapType, StringType, StructField, StructType

SCHEMA_VERSION = 1


def _strings(names: str, nullable: tuple[str, ...] = ()) -> list[StructField]:
    return [StructField(n, StringType(), n in nullable) for n in names.split()]


DOCUMENTS = StructType(_strings("id page_id title local_path space_key source_url last_modified_at content_hash updated_at"))
CHUNKS = StructType([*_strings("id document_id"), StructField("chunk_index", IntegerType(), False), *_strings("text chunk_hash updated_at")])
EMBEDDINGS = StructType([*_strings("chunk_id model"), StructField("dimension", IntegerType(), False), StructField("vector", ArrayType(FloatType(), False), False), *_strings("updated_at")])
RUNS = StructType(_strings("id started_at completed_at mode", ("completed_at",)))
#: One row a (chunk, column, term): where in the column the term stands.
POSTINGS = StructType([*_strings("chunk_id col term"), StructField("positions", ArrayType(IntegerType(), False), False)])
#: Tokens of each chunk over all columns.
LENGTHS = StructType([*_strings("chunk_id"), StructField("n_tokens", IntegerType(), False)])
TABLES = {"documents": DOCUMENTS, "chunks": CHUNKS, "embeddings": EMBEDDINGS, "postings": POSTINGS, "lengths": LENGTHS}
METADATA = StructType([StructField("pages", MapType(StringType(), StructType(_strings("local_path title space_key last_modified_at source_url", ("local_path", "title", "space_key", "last_modified_at", "source_url")))))])


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """df with the schema's columns, in its order; a column that older data lack is filled with the empty string."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit("")).cast(f.dataType.simpleString()).alias(f.name) for f in schema))
