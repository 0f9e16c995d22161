"""The feature pipeline: impute, scale, one-hot, assemble.

Fitted on training rows only. Fitting is a few aggregates; transforming is one projection with literals,
which also works on a stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabkit.functions.kinds import BOOLEAN, DATETIME, NUMERIC, TEXT, col, columns_of
from tabkit.functions.quantiles import quantiles
from tabkit.functions.stats import finite_or_null
from tabkit.operators.hygiene import modes

MAX_CATEGORIES = 10_000
FEATURES = "features"


def _safe(name: str) -> str:
    return name.replace(".", "_").replace("`", "_")


class _PrepParams(Params):
    numericCols = Param(Params._dummy(), "numericCols", "numeric features", TypeConverters.toListString)
    textCols = Param(Params._dummy(), "textCols", "text features", TypeConverters.toListString)
    plainCols = Param(Params._dummy(), "plainCols", "features passed through as numbers", TypeConverters.toListString)
    exact = Param(Params._dummy(), "exact", "exact medians", TypeConverters.toBoolean)
    medians = Param(Params._dummy(), "medians", "fill value per numeric feature", TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "mean after filling", TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "population std after filling, 1 without spread", TypeConverters.toListFloat)
    fills = Param(Params._dummy(), "fills", "fill value per text feature", TypeConverters.toListString)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(
            numericCols=[], textCols=[], plainCols=[], exact=True, medians=[], means=[], scales=[], fills=[]
        )

    def get(self, name: str):
        return self.getOrDefault(self.getParam(name))

    def input_columns(self) -> list[str]:
        return [*self.get("numericCols"), *self.get("textCols"), *self.get("plainCols")]


class TablePrep(Estimator, _PrepParams, DefaultParamsReadable, DefaultParamsWritable):
    """Median-fill and standardise numbers, mode-fill texts, pass booleans and timestamps as numbers."""

    @keyword_only
    def __init__(self, *, numericCols=None, textCols=None, plainCols=None, exact=True) -> None:
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> TablePrepModel:
        numeric, text = self.get("numericCols"), self.get("textCols")
        found = quantiles(dataset, numeric, [0.5], exact=self.get("exact"))
        medians = [found[c][0] if found[c][0] is not None else 0.0 for c in numeric]
        means, scales = [], []
        if numeric:
            filled = [F.coalesce(finite_or_null(c), F.lit(m)) for c, m in zip(numeric, medians)]
            stats = dataset.agg(
                *[f(x).alias(f"{f.__name__}{i}") for i, x in enumerate(filled) for f in (F.avg, F.stddev_pop)]
            ).first()
            means = [stats[2 * i] or 0.0 for i in range(len(numeric))]
            scales = [stats[2 * i + 1] or 1.0 for i in range(len(numeric))]
        top = modes(dataset.select(*[col(c).cast("string").alias(c) for c in text]), text) if text else {}
        fills = [top[c] if top[c] is not None else "Unknown" for c in text]
        model = TablePrepModel()
        model._set(
            numericCols=numeric, textCols=text, plainCols=self.get("plainCols"),
            medians=medians, means=means, scales=scales, fills=fills,
        )
        return model


class TablePrepModel(Model, _PrepParams, DefaultParamsReadable, DefaultParamsWritable):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        out: dict[str, Column] = {}
        for c, median, mean, scale in zip(
            self.get("numericCols"), self.get("medians"), self.get("means"), self.get("scales")
        ):
            out[f"num__{_safe(c)}"] = (F.coalesce(finite_or_null(c), F.lit(median)) - F.lit(mean)) / F.lit(scale)
        for c, fill in zip(self.get("textCols"), self.get("fills")):
            out[f"txt__{_safe(c)}"] = F.coalesce(col(c).cast("string"), F.lit(fill))
        for c in self.get("plainCols"):
            value = col(c)
            if dict(dataset.dtypes)[c] not in ("boolean", "double"):
                value = F.unix_timestamp(value.cast("timestamp"))
            out[f"remainder__{_safe(c)}"] = F.coalesce(value.cast("double"), F.lit(0.0))
        return dataset.withColumns(out) if out else dataset


def check_categories(df: DataFrame, columns: Sequence[str], limit: int = MAX_CATEGORIES) -> None:
    """Dictionaries of categories and classes live on the driver and widen vectors, so their size is checked first."""
    if not columns:
        return
    rough = df.agg(*[F.approx_count_distinct(col(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    # the estimate spares most columns a count; near the limit and beyond it the count decides
    wide = [c for i, c in enumerate(columns) if rough[i] > limit / 2 and df.select(col(c)).distinct().limit(limit + 2).where(col(c).isNotNull()).count() > limit]
    if wide:
        raise ValueError(
            f"more than {limit} categories in {', '.join(wide)}: drop or regroup these columns, or raise max_categories"
        )


def feature_columns(df: DataFrame, target: str, exclude: Sequence[str] = (), passthrough_timestamps: bool = False) -> list[str]:
    """The columns that ``feature_stages`` makes features of."""
    kinds = [NUMERIC, TEXT, BOOLEAN, *([DATETIME] if passthrough_timestamps else [])]
    return columns_of(df, *kinds, exclude=[target, *exclude])


def feature_stages(
    df: DataFrame,
    target: str,
    exclude: Sequence[str] = (),
    passthrough_timestamps: bool = False,
    max_categories: int = MAX_CATEGORIES,
    exact: bool = True,
) -> list:
    """Pipeline stages that turn a table into a ``features`` vector.

    Categories not seen in training, like the last level dropped by the encoder, give all zeros.
    """
    skipped = [target, *exclude]
    numeric = columns_of(df, NUMERIC, exclude=skipped)
    text = columns_of(df, TEXT, exclude=skipped)
    plain = columns_of(df, BOOLEAN, *([DATETIME] if passthrough_timestamps else []), exclude=skipped)
    if not (numeric or text or plain):
        raise ValueError("the table has no usable feature")
    check_categories(df, text, max_categories)
    stages: list = [TablePrep(numericCols=numeric, textCols=text, plainCols=plain, exact=exact)]
    inputs = [f"num__{_safe(c)}" for c in numeric]
    if text:
        codes, encoded = [f"idx__{_safe(c)}" for c in text], [f"cat__{_safe(c)}" for c in text]
        stages.append(
            StringIndexer(
                inputCols=[f"txt__{_safe(c)}" for c in text], outputCols=codes, handleInvalid="keep",
                stringOrderType="alphabetAsc",
            )
        )
        stages.append(OneHotEncoder(inputCols=codes, outputCols=encoded, dropLast=True))
        inputs += encoded
    inputs += [f"remainder__{_safe(c)}" for c in plain]
    stages.append(VectorAssembler(inputCols=inputs, outputCol=FEATURES))
    return stages


def feature_names(df: DataFrame, features: str = FEATURES) -> list[str]:
    """Names of the vector's entries, from the metadata of the assembled column."""
    attributes = df.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    listed = sorted((a for group in attributes.values() for a in group), key=lambda a: a["idx"])
    return [a.get("name", f"feature_{a['idx']}") for a in listed]


def drop_intermediate(df: DataFrame) -> DataFrame:
    """Remove the helper columns of the pipeline."""
    helpers = ("num__", "txt__", "idx__", "cat__", "remainder__")
    return df.drop(*[c for c in df.columns if c.startswith(helpers)], FEATURES)


def align_to_features(df: DataFrame, numeric: Sequence[str], text: Sequence[str], plain: Sequence[str] = ()) -> DataFrame:
    """Scoring input in the shape of the training features; a number that cannot be read becomes null.

    Columns the model does not know are kept behind the features.
    """
    known = [*numeric, *text, *plain]
    missing = [c for c in known if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing in the data to score: {', '.join(missing)}")

    types = dict(df.dtypes)

    def number(c: str) -> Column:
        return col(c).try_cast("double") if types[c] == "string" else col(c)

    rest = [col(c) for c in df.columns if c not in known]
    return df.select(
        *[number(c).alias(c) for c in numeric], *[col(c).cast("string").alias(c) for c in text],
        *[col(c) for c in plain], *rest,
    )
