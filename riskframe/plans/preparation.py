"""Preprocessing as stages of an ML ``Pipeline`` that save and load like Spark's own.

What a stage learns is one table (donors, medians, modes, categories), written as parquet
beside the stage's parameters, so ``PipelineModel.load`` needs nothing but the folder.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable,
                             MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators import neighbors, prep
from riskframe.profiles import PROFILES, Profile
from riskframe.session import materialize


class DeriveFeatures(Transformer, DefaultParamsWritable, DefaultParamsReadable):
    """Derived clinical features of a profile; its boolean-looking categories become True / False labels."""

    profile = Param(Params._dummy(), "profile", "name of the profile", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, profile: str | None = None) -> None:
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        prof = PROFILES[self.getOrDefault(self.profile)]
        out = {}
        for c in prof.boolean:
            b = F.lower(F.col(c))
            out[c] = F.when(b.isin("true", "1"), F.lit("True")).when(b.isin("false", "0"), F.lit("False")).otherwise(F.col(c))
        df = prof.engineer(df)
        return df.withColumns(out) if out else df


class _Columns(HasInputCols):
    keyCol = Param(Params._dummy(), "keyCol", "column that tells rows apart", TypeConverters.toString)
    neighbors = Param(Params._dummy(), "neighbors", "donors of a missing value", TypeConverters.toInt)


class _TableWriter(MLWriter):
    def __init__(self, model: TableModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.table.write.parquet(f"{path}/table")


class _TableReader(MLReader):
    def __init__(self, cls) -> None:
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> TableModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(self.sparkSession.read.parquet(f"{path}/table"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class TableModel(Model, _Columns, MLWritable, MLReadable):
    """A stage that has learned one table."""

    def __init__(self, table: DataFrame | None = None) -> None:
        super().__init__()
        self._setDefault(neighbors=5)
        self.table = table

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)


class TableEstimator(Estimator, _Columns, DefaultParamsWritable, DefaultParamsReadable):
    """Learns a table of ``inputCols`` and gives ``model`` with it."""

    model: type[TableModel]

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, keyCol: str | None = None, neighbors: int = 5) -> None:
        super().__init__()
        self._setDefault(neighbors=5)
        self._set(**self._input_kwargs)

    def learn(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _fit(self, df: DataFrame) -> TableModel:
        return self._copyValues(self.model(materialize(self.learn(df), "stage")))


class KnnImputerModel(TableModel):
    """Missing numbers become means over the nearest training rows."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return neighbors.knn_impute(df, self.table, self.getOrDefault(self.keyCol), self.getInputCols(),
                                    k=self.getOrDefault(self.neighbors))


class KnnImputer(TableEstimator):
    model = KnnImputerModel

    def learn(self, df: DataFrame) -> DataFrame:
        return df.select(self.getOrDefault(self.keyCol), *self.getInputCols())


class RobustScalerModel(TableModel):
    """(x - median) / IQR."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return prep.apply_robust(df, self.table)


class RobustScaler(TableEstimator):
    model = RobustScalerModel

    def learn(self, df: DataFrame) -> DataFrame:
        return prep.fit_robust(df, self.getInputCols())


class ModeImputerModel(TableModel):
    """Missing categories become the most frequent one."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return prep.apply_mode(df, self.table)


class ModeImputer(TableEstimator):
    model = ModeImputerModel

    def learn(self, df: DataFrame) -> DataFrame:
        return prep.fit_mode(df, self.getInputCols())


class OneHotModel(TableModel):
    """A 0/1 column for each category seen in training."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return prep.apply_one_hot(df, self.table)

    def names(self) -> list[str]:
        return [n for _, _, n in prep.one_hot_names(self.table)]


class OneHot(TableEstimator):
    model = OneHotModel

    def learn(self, df: DataFrame) -> DataFrame:
        return prep.fit_one_hot(df, self.getInputCols())


def preparation(prof: Profile) -> Pipeline:
    """Raw patients to model inputs: derived features, then numbers (nearest neighbours, robust scale) and
    categories (mode, one-hot)."""
    num, cat = prof.features_numeric, prof.categorical
    return Pipeline(stages=[DeriveFeatures(profile=prof.name), KnnImputer(inputCols=num, keyCol=prof.key),
                            RobustScaler(inputCols=num), ModeImputer(inputCols=cat), OneHot(inputCols=cat)])
