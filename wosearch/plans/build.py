"""Raw work orders to vector table."""

from pyspark.sql import DataFrame

from wosearch.functions.representation import with_representations
from wosearch.operators.cleaning import clean, preprocess
from wosearch.operators.encoding import Encoder, embed_documents
from wosearch.session import materialise, spread
from wosearch.sources.vector_table import write_stage


def build_vectors(raw: DataFrame, encoder: Encoder) -> DataFrame:
    """Normalise, clean, represent and embed. The normalised rows are written once, because
    cleaning reads them twice and the text work costs more than the disk.
    """
    cleaned = clean(materialise(preprocess(raw), "preprocessed"))
    return embed_documents(with_representations(cleaned), encoder)


def build_tables(raw: DataFrame, folder: str, encoder: Encoder) -> DataFrame:
    """Stage by stage with every stage kept on disk; a finished stage is not run again."""
    preprocessed = write_stage(preprocess(raw), f"{folder}/preprocessed")
    cleaned = write_stage(clean(preprocessed), f"{folder}/cleaned")
    return write_stage(
        embed_documents(with_representations(spread(cleaned)), encoder), f"{folder}/vectors"
    )
