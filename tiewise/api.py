"""The names a user of the package needs, in the order of a study: data, specification, description, estimation, tests, interpretation."""

# Data: networks, behaviour, covariates, composition, groups, files.
from tiewise.sources.build import behaviour, covariate, dyadic, network, node_set, panel_of
from tiewise.sources.coded import Coded, composed, end_networks, events, filled_behaviour, grouped, imputed, low_integers, presence, recentred, start_networks
from tiewise.sources.files import read_composition, read_edges, read_matrix, read_pajek, read_session
from tiewise.sources.panel import Panel

# Specification and statistics.
from tiewise.operators.effects import FAMILIES, effect, of_type
from tiewise.operators.specification import ModelOptions, OutputOptions, Row, documentation, gmm_statistics, include, interaction, offered, set_effect, table, time_dummies, update_specification, update_theta
from tiewise.plans.features import Effect, SparkFeatures, features_of

# Description.
from tiewise.operators.coded import changes, degree_moments, impossible_changes, input_report, missing_share, no_change, symmetric
from tiewise.operators.descriptives import behaviour_changes, behaviour_distance, behaviour_distribution, continuous_changes, degree_distribution, density, dyad_census, higher, tie_changes

# Simulation and estimation.
from tiewise.operators.estimation import Algorithm, Fit, estimate, rules_of, simulate_only, starting_density, starting_flow, starting_rates, starting_tendency
from tiewise.operators.kernel import Flow, Rules, State, Term
from tiewise.operators.likelihood import LikelihoodFit, maximise
from tiewise.operators.simulation import chain_likelihood, chains, model_periods, simulated_behaviour, simulated_ties, simulations, targets

# Goodness of fit and tests.
from tiewise.operators.goodness import category_pairs, dyadic_counts, geodesics, monte_carlo_test, triad_census
from tiewise.operators.inference import degree_counts, fit_of, likelihood_ratio, mixed_triad_census, one_step_distance, path_ratio, quantiles, same, score_test, several, time_test, wald

# Many fits, interpretation and reports.
from tiewise.operators.choices import behaviour_choices, contributions, importance, probabilities
from tiewise.operators.inference import importance_along, influence_table, relative_importance, selection_table, table_maximum
from tiewise.operators.meta import combine, draws_summary, funnel, likelihood, weighted_regression
from tiewise.operators.reports import as_html, as_latex, as_text, write

__all__ = [name for name in dir() if not name.startswith("_")]
