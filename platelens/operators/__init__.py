"""DataFrame operators: null handling, translation joins, reports,
distributed ranking, scaling, k-means, PCA and join helpers."""

from . import joins, kmeans, nulls, pca, ranking, reports, scaling, translate

__all__ = ["joins", "kmeans", "nulls", "pca", "ranking", "reports", "scaling", "translate"]
