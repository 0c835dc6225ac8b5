"""The full-text tokenizer: runs of letters, digits and private-use characters, folded."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .folding import SOURCE, TARGET

_RUN = r"[\p{L}\p{N}\p{Co}]+"
_TABLE = str.maketrans(dict(zip(SOURCE, TARGET)) | dict.fromkeys(SOURCE[len(TARGET) :], ""))


def tokens(text: Column) -> Column:
    """array<string> of a column's tokens, in order."""
    return F.regexp_extract_all(F.translate(text, SOURCE, TARGET), F.lit(_RUN), F.lit(0))


def token_list(text: str) -> list[str]:
    """The tokens of a Python string."""
    import unicodedata

    kept = "".join(c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co" else " " for c in text.translate(_TABLE))
    return re.findall(r"\S+", kept)
