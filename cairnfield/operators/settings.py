"""The contract of a run's settings as a table of typed rules, joined to settings as rows."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The settings of a forecast run, their kinds and bounds. A line is: name, kind, then "required", bounds, the
# choices in braces, "counts" and the list that the setting counts, or "if" and the setting and value that call for it.
CONTRACT = """
run_type text required {calibration,validation,forecasting,testing}
steps list required
time_steps int required counts steps
input_channels int required >=1
output_channels int required >=1
n_quantiles int >=2 if output_distribution=quantile
regression_targets list required
classification_targets list required
identity_cols list required
features list required
transformations map required
derivations map
height int required >=1
width int required >=1
index_names list required
time_col text required
id_col text required
spatial_cols list required
row_offset int required
col_offset int required
model text required
window_dim int required
total_hidden_channels int required
dropout_rate number required >=0 <=1
weight_init text required
learning_rate number required >0
weight_decay number required >=0
windows_per_lesson int required >=1
scheduler text required
warmup_steps int required >=1
clip_grad_norm flag required
loss_reg text required
loss_class text required
loss_reg_a number if loss_reg=shrinkage
loss_reg_c number if loss_reg=shrinkage
loss_reg_sigma number if loss_reg=tobit
loss_reg_pareto_alpha number if loss_reg=pareto
loss_class_gamma number if loss_class=focal
loss_class_alpha number if loss_class=focal
onset_bias_init number
body_supervision text {all,active}
onset_lead int >=0
cessation_lag int >=0
qs99_weight number >=0
qs99_tau number >0 <1
target_weights map
learnable_sigma flag
loss_reg_theta_init number >0 if loss_reg=hurdle_nb
learnable_theta flag
loss_class_pos_weight number
output_distribution text
reg_activation text {softplus,relu}
forecast_composition text {self_zeroed,soft_gate,threshold_gate}
gate_threshold number >0 <1 if forecast_composition=threshold_gate
emit_family_core flag
rollout_feedback text {mean,sample,teacher_forced}
ss_schedule text
ss_epsilon_max number >=0 <=1
ss_feedback text {mean,sample}
ss_warmup_lessons int >=1
ss_k number >0
total_lessons int required >=1
n_posterior_samples int required >=1
n_head_samples int >=1
np_seed int required
torch_seed int required
sampling_strategy text required
sampling_alpha number if sampling_strategy=power_law
sampling_temperature number if sampling_strategy=boltzmann
sampling_steepness number if sampling_strategy=sigmoid
min_events int required
slope_ratio number required
roof_ratio number required
max_ratio number required
min_ratio number required
feedback_clamp_log1p list
min_free_disk_gb number >0
max_posterior_cube_gb number >0
pi_penalty_weight number >=0
pi_penalty_prior_logit number
static_channels list
freeze_multitask_balancer flag
rollout_horizon int >=1
sweep flag
random_flips flag
diagnostic_visualizations flag
evaluation_mode text required {stochastic,point}
aggregate_method text required {arithmetic_mean,mean,median,max_aposteriori,geometric_mean}
model_time_stamp text
"""


@dataclass(frozen=True)
class Rule:
    field: str
    kind: str
    required: bool = False
    low: float | None = None
    low_open: bool = False
    high: float | None = None
    high_open: bool = False
    choices: tuple[str, ...] | None = None
    counts: str | None = None
    when_field: str | None = None
    when_value: str | None = None


def rules(text: str = CONTRACT) -> list[Rule]:
    """The rules of a contract's text."""
    out = []
    for line in filter(None, map(str.strip, text.splitlines())):
        field, kind, *words = line.split()
        given: dict = {"field": field, "kind": kind, "required": "required" in words}
        for i, word in enumerate(words):
            if m := re.fullmatch(r"([<>])(=?)(-?[\d.]+)", word):
                side = "low" if m[1] == ">" else "high"
                given |= {side: float(m[3]), f"{side}_open": not m[2]}
            elif word.startswith("{"):
                given["choices"] = tuple(word[1:-1].split(","))
            elif word == "counts":
                given["counts"] = words[i + 1]
            elif word == "if":
                given["when_field"], given["when_value"] = words[i + 1].split("=")
        out.append(Rule(**given))
    return out


SCHEMA = "field string, kind string, required boolean, low double, low_open boolean, high double, high_open boolean, choices array<string>, counts string, when_field string, when_value string"


def rule_table(spark: SparkSession, given: Sequence[Rule]) -> DataFrame:
    return spark.createDataFrame([tuple(list(v) if isinstance(v, tuple) else v for v in vars(r).values()) for r in given], SCHEMA)


def violations(settings: DataFrame, given: Sequence[Rule]) -> DataFrame:
    """(run, field, violation) of settings as rows (run, key, value), value being text and lists and maps JSON.

    ``missing``: a required setting, or one that another setting calls for, is absent or null; ``unknown``: no rule names the
    setting; ``kind``, ``range``, ``choice``: what the value is not; ``count``: it is not the length of the list it counts. A run is one
    group of at most as many settings as it has; rules are a table of fixed size.
    """
    known = F.broadcast(rule_table(settings.sparkSession, given))
    v = F.col("value")
    number, listed = F.expr("try_cast(value as double)"), F.col("other")
    kinds = F.when(F.col("kind") == "int", F.expr("try_cast(value as bigint)").isNotNull()).when(F.col("kind") == "number", number.isNotNull()).when(F.col("kind") == "flag", F.lower(v).isin("true", "false")).when(F.col("kind") == "list", v.rlike(r"^\s*\[.*\]\s*$")).when(F.col("kind") == "map", v.rlike(r"^\s*\{.*\}\s*$")).otherwise(True)
    below = (number < F.col("low")) | (F.col("low_open") & (number == F.col("low")))
    above = (number > F.col("high")) | (F.col("high_open") & (number == F.col("high")))
    run = settings.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("all"))
    placed = run.crossJoin(known).select("*", F.try_element_at("all", F.col("field")).alias("value"), F.try_element_at("all", F.col("counts")).alias("other"), F.try_element_at("all", F.col("when_field")).alias("cause"))
    asked = F.col("required") | F.coalesce(F.col("cause") == F.col("when_value"), F.lit(False))
    found = F.array(
        F.when(v.isNull() & asked, "missing"),
        F.when(v.isNotNull() & ~kinds, "kind"),
        F.when(v.isNotNull() & F.coalesce(below | above, below, above, F.lit(False)), "range"),
        F.when(v.isNotNull() & F.col("choices").isNotNull() & ~F.array_contains("choices", v), "choice"),
        F.when(number.isNotNull() & listed.isNotNull() & (F.coalesce(F.json_array_length(listed), F.lit(-1)) != number), "count"),
    )
    broken = placed.select("run", "field", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("violation"))
    unknown = settings.join(known.select("field"), F.col("key") == F.col("field"), "left_anti").select("run", F.col("key").alias("field"), F.lit("unknown").alias("violation"))
    return broken.unionByName(unknown)
