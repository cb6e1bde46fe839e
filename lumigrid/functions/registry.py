"""The 31 features of a search: their columns, metrics, dimensions and groups."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Feature:
    name: str
    metric: str
    column: str
    dim: int
    group: str


#: Feature, metric, column, dimension (0: not a vector), group.
FEATURES: dict[str, Feature] = {
    f.name: f
    for f in (
        Feature("brightness", "scalar", "brightness", 0, "basic"),
        Feature("contrast", "scalar", "contrast", 0, "basic"),
        Feature("saturation", "scalar", "saturation", 0, "basic"),
        Feature("edge_density", "scalar", "edge_density", 0, "basic"),
        Feature("sharpness", "sharpness", "sharpness", 0, "basic"),
        Feature("meta_hist_interp", "cosine", "meta_hist_interp", 152, "color"),
        Feature("meta_cdf_interp", "cosine", "meta_cdf_interp", 152, "color"),
        Feature("meta_joint_interp", "cosine", "meta_joint_interp", 384, "color"),
        Feature("meta_cell", "cosine", "meta_cell_vector", 304, "color"),
        Feature("meta_moments_mean", "l2_cell", "meta_moments_mean", 19, "color"),
        Feature("meta_moments_std", "l2_cell", "meta_moments_std", 19, "color"),
        Feature("meta_moments_skew", "l2_cell", "meta_moments_skew", 19, "color"),
        Feature("hog", "cosine", "hog_vector", 1568, "advanced"),
        Feature("hu_moments", "cosine", "hu_moments_vector", 7, "advanced"),
        Feature("lbp", "cosine", "lbp_vector", 160, "advanced"),
        Feature("gabor", "cosine", "gabor_vector", 512, "advanced"),
        Feature("ccv", "cosine", "ccv_vector", 96, "advanced"),
        Feature("fourier", "cosine", "fourier_vector", 25, "advanced"),
        Feature("geo", "cosine", "geo_vector", 6, "advanced"),
        Feature("tamura", "cosine", "tamura_vector", 3, "advanced"),
        Feature("edge_orientation", "cosine", "edge_orientation_vector", 5, "advanced"),
        Feature("glcm", "cosine", "glcm_vector", 64, "advanced"),
        Feature("wavelet", "cosine", "wavelet_vector", 12, "advanced"),
        Feature("correlogram", "cosine", "correlogram_vector", 32, "advanced"),
        Feature("ehd", "cosine", "ehd_vector", 80, "advanced"),
        Feature("cld", "cosine", "cld_vector", 64, "advanced"),
        Feature("spm", "cosine", "spm_vector", 160, "advanced"),
        Feature("saliency", "cosine", "saliency_vector", 32, "advanced"),
        Feature("semantic", "cosine", "llm_embedding", 1024, "deep"),
        Feature("category", "category", "category", 0, "basic"),
        Feature("entity", "entity", "entities", 0, "basic"),
    )
}
PREVIEWS = ("hist", "cell", "hog", "hu", "lbp", "gabor", "ccv")
DREAMSIM_DIM = 1792


def image_schema():
    """The schema of the wide image table."""
    from pyspark.sql import types as T

    vector = T.ArrayType(T.FloatType(), False)
    fields = [T.StructField("id", T.LongType(), False), T.StructField("file_name", T.StringType(), False), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]
    kinds = {"scalar": T.DoubleType(), "sharpness": T.DoubleType(), "cosine": vector, "l2_cell": vector, "category": T.StringType(), "entity": T.ArrayType(T.StringType())}
    fields += [T.StructField(f.column, kinds[f.metric]) for f in FEATURES.values()]
    fields += [T.StructField("description", T.StringType()), T.StructField("dreamsim_vector", vector), T.StructField("file_path", T.StringType())]
    fields += [T.StructField(f"{p}_vis_path", T.StringType()) for p in PREVIEWS]
    return T.StructType([*fields, T.StructField("file_hash", T.StringType()), T.StructField("created_at", T.TimestampNTZType())])
