"""The models that are tried, in their fixed order."""

from __future__ import annotations

from collections.abc import Callable

from ..operators.models import boosting, forests, gaussian, linear, margins, neighbors, online, stumps, trees, voting
from ..operators.profile import CLASSIFICATION

# The model names shown in a leaderboard, in the order they are tried.
CLASSIFIERS: dict[str, Callable] = {
    "Logistic Regression": trees.logistic_regression,
    "SGD Classifier": margins.sgd_classifier,
    "Passive Aggressive Classifier": online.passive_aggressive_classifier,
    "Decision Tree Classifier": forests.decision_tree_classifier,
    "Random Forest Classifier": forests.random_forest_classifier,
    "Gradient Boosting Classifier": boosting.gradient_boosting_classifier,
    "AdaBoost Classifier": stumps.ada_boost_classifier,
    "Extra Trees Classifier": forests.extra_trees_classifier,
    "Support Vector Classifier": margins.svc,
    "Linear SVC": margins.linear_svc,
    "NuSVC": margins.nu_svc,
    "K-Nearest Neighbors": neighbors.knn_classifier,
    "Multi-layer Perceptron": online.network_classifier,
    "Gaussian Naive Bayes": gaussian.gaussian_nb,
    "Linear Discriminant Analysis": gaussian.lda,
    "Quadratic Discriminant Analysis": gaussian.qda,
    "Voting Classifier": voting.voting_classifier,
    "Bagging Classifier": forests.bagging_classifier,
    "HistGradient Boosting Classifier": boosting.histogram_boosting_classifier,
}

# Short names and class names of the regressors. Two names may stand for one
# algorithm with the same settings; it is then fitted once and listed under both.
REGRESSORS: dict[str, Callable] = {
    "lr": linear.ols,
    "ridge": linear.ridge,
    "lasso": linear.lasso,
    "en": linear.elastic_net,
    "br": linear.bayesian_ridge,
    "ard": linear.ard,
    "huber": linear.huber,
    "par": online.passive_aggressive_regressor,
    "svm": margins.svr,
    "knn": neighbors.knn_regressor,
    "dt": forests.decision_tree_regressor,
    "rf": forests.random_forest_regressor,
    "et": forests.extra_trees_regressor,
    "ada": trees.ada_boost_regressor,
    "gbr": trees.gradient_boosting_regressor,
    "mlp": online.network_regressor,
    "Ridge": linear.ridge,
    "Lasso": linear.lasso,
    "ElasticNet": linear.elastic_net,
    "BayesianRidge": linear.bayesian_ridge,
    "ARDRegression": linear.ard,
    "HuberRegressor": linear.huber,
    "PassiveAggressiveRegressor": online.passive_aggressive_regressor,
    "SGDRegressor": linear.sgd_regressor,
    "DecisionTreeRegressor": forests.decision_tree_regressor,
    "RandomForestRegressor": forests.random_forest_regressor,
    "ExtraTreesRegressor": forests.extra_trees_regressor,
    "GradientBoostingRegressor": trees.gradient_boosting_regressor,
    "AdaBoostRegressor": trees.ada_boost_regressor,
    "KNeighborsRegressor": neighbors.knn_regressor,
    "SVR": margins.svr,
    "NuSVR": margins.nu_svr,
}


def models_for(task: str) -> dict[str, Callable]:
    return CLASSIFIERS if task == CLASSIFICATION else REGRESSORS
