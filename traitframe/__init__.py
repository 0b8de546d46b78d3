"""Feature tables keyed by sample: nested cross-validation, preprocessing, genotypes, models and rankings on Spark."""

from traitframe.operators.blocks import block_embed, fit_block_weights
from traitframe.operators.folds import fold_grid, fold_roles, random_fragments, with_folds
from traitframe.operators.genotypes import block_snp_lists, onehot_calls, snp_index, snps_in_genes
from traitframe.operators.importance import importance_scores, importance_trials, linear_importance_trials, merge_rankings, permutation_pairs, permute_features
from traitframe.operators.joint_blocks import block_embed_sites, fit_joint_block_weights
from traitframe.operators.metrics import auroc, classification_metrics, evaluate_folds, regression_metrics
from traitframe.operators.preprocess import apply_steps, fit_labels, fit_omics
from traitframe.operators.samples import melt_labels, melt_omics, pad_samples, shared_ids
from traitframe.operators.steps import MaxAbsScale, RobustScale, SeenFilter, Step
from traitframe.operators.trials import best_inner, best_overall, best_trials, inferior_trials, leaderboard
from traitframe.plans.genotypes import encode_genotypes
from traitframe.plans.hidden import Layout, best_models, load_hidden, predict_hidden, sweep_hidden
from traitframe.plans.models import DualExtraction, fit_dual_extraction, predict_fold, predict_overall, sweep
from traitframe.plans.ncv import ForestSettings, apply_preprocessors, assemble, fit_whole, prepare_ncv, read_once, write_once, write_prepared
from traitframe.plans.ranking import collect_ranks, rank_features, rank_outer_fold
from traitframe.sources.folds import read_fold_tagged, read_folds, write_folds
from traitframe.sources.genome import read_gff_genes, read_vcf_calls, read_vcf_sites
from traitframe.sources.site_store import read_sites, site_calls, write_site_store
from traitframe.sources.tables import read_genotypes, read_labels, read_labels_long, read_omics, read_omics_long

__all__ = [name for name in dir() if not name.startswith("_")]
