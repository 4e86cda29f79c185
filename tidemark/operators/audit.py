"""Audits and verifications as rule columns over record tables: every finding of a record is named, none hides another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import rule_flags


def _fails(ok: Column) -> Column:
    """A condition that is not known to hold fails."""
    return ~F.coalesce(ok, F.lit(False))


def _same(*columns: Column) -> Column:
    out = columns[0].isNotNull()
    for c in columns[1:]:
        out = out & (c == columns[0])
    return out


def _entries(c: str) -> Column:
    return F.array_sort(F.map_entries(F.col(c)))


def holdout_audit(records: DataFrame) -> DataFrame:
    """``records`` with ``findings``: which of the fifteen statements about a completed holdout do not hold, in a fixed order.

    A record has the registry's view (state, reservation_seq, revealed_seq, reservation_event, revealed_manifest,
    uses: array of (source, event), attempts: array of (status, outcome, artifact)), the result's own claims
    (training_updates, model_before, model_after, candidate, manifest, definition, evaluation, costs, constraints,
    bound_artifacts, attempt_count, attempts_hash, identity, reservation_id, config), what was frozen before it
    (frozen_candidate, frozen_manifest, frozen_definition, frozen_evaluation, frozen_identity), the study's plan
    (compiled_definition, compiled_costs, compiled_constraints, required_families, study_identity), what is found
    now (model_now, families, found_artifacts, manifest_file, attempts_now) and, for the holdout's and the
    development run (prefix run_ and dev_), final_hash, bound_hash, id, bound_id, status, stage, config,
    bound_config, artifacts and found (maps of name to hash); development_keys and analyst_texts are what the
    development run and the analyst's files hold, forbidden_keys and secrets what they must not.
    """
    c = F.col
    bound = lambda p, stage: (_same(c(f"{p}_final_hash"), c(f"{p}_bound_hash")) & _same(c(f"{p}_id"), c(f"{p}_bound_id")) & (c(f"{p}_status") == "complete") & (c(f"{p}_stage") == stage)
                              & _same(c(f"{p}_config"), c(f"{p}_bound_config")) & (_entries(f"{p}_artifacts") == _entries(f"{p}_found")))
    attempts = F.forall("attempts", lambda a: a["status"] == "completed") & F.forall("attempts", lambda a: (a["outcome"] != "proposal") | a["artifact"].isNotNull())
    one_use = (F.size("uses") == 1) & (c("uses")[0]["source"] == "reveal_reservation") & (c("uses")[0]["event"] == c("reservation_event"))
    leaked = F.exists("analyst_texts", lambda t: F.exists("secrets", lambda s: t.contains(s)))
    statements = (
        ("registry_state_revealed", c("state") == "holdout_revealed"), ("reservation_precedes_result", c("reservation_seq") < c("revealed_seq")), ("global_holdout_use_recorded", one_use),
        ("frozen_model_unchanged", (c("training_updates") == 0) & _same(c("model_before"), c("model_after"), c("model_now"))), ("candidate_lineage_exact", _same(c("candidate"), c("frozen_candidate")) & _same(c("manifest"), c("frozen_manifest"))),
        ("execution_contracts_unchanged", _same(c("definition"), c("compiled_definition"), c("frozen_definition")) & _same(c("evaluation"), c("frozen_evaluation")) & _same(c("costs"), c("compiled_costs")) & _same(c("constraints"), c("compiled_constraints"))),
        ("required_baselines_present", F.size(F.array_except("required_families", "families")) == 0), ("holdout_result_artifact_hashes_bound", _entries("bound_artifacts") == _entries("found_artifacts")),
        ("holdout_pipeline_run_bound", bound("run", "holdout_evaluation")), ("development_pipeline_run_bound", bound("dev", "backtest")),
        ("all_attempts_retained", attempts & (c("attempt_count") == F.size("attempts")) & _same(c("attempts_hash"), c("attempts_now"))), ("holdout_contract_exact", _same(c("identity"), c("frozen_identity"), c("study_identity"))),
        ("development_reserved_result_absent", ~F.arrays_overlap("development_keys", "forbidden_keys")), ("analyst_holdout_result_unreachable", ~leaked), ("holdout_manifest_file_hash_bound", _same(c("revealed_manifest"), c("manifest_file"))))
    return records.withColumn("findings", rule_flags(*((name, _fails(ok)) for name, ok in statements)))


def proposal_checks(proposals: DataFrame) -> DataFrame:
    """``proposals`` with ``failed``: which verification checks an agent's proposal or abstention does not pass, in a fixed order.

    kind (proposal or abstention), ids and their expected values (study, bundle, snapshot: array of names;
    expected: the same), attempt_status, tool_results and round_results (arrays of hashes), rounds: array of
    (step, previous, id), content_hash and recomputed_hash, artifact_hash, texts and forbidden (words that no text
    may hold). Proposals also: citations, counter_citations and retrieved (arrays of evidence ids), searches and
    queries (arrays of query ids), claims: array of (value, reference) and references: map of id to value, scope and
    study_scope (arrays), inputs and catalogue, template and templates, parameters: map of name to number, space: map
    of name to (low, high), controls and required_controls, conditions: array of lists that must not be empty,
    latest_available and cutoff. Abstentions also: reason, missing_inputs.
    """
    c = F.col
    proposal, abstention = c("kind") == "proposal", c("kind") == "abstention"
    within = lambda a, b: F.size(F.array_except(a, b)) == 0
    chain = F.aggregate("rounds", F.struct(F.lit(1).alias("n"), F.repeat(F.lit("0"), F.lit(64)).alias("last"), F.lit(True).alias("ok")), lambda a, r: F.struct(
        (a["n"] + 1).alias("n"), r["id"].alias("last"), (a["ok"] & (r["step"] == a["n"]) & (r["previous"] == a["last"])).alias("ok")), lambda a: a["ok"])
    clean = ~F.exists("texts", lambda t: F.exists("forbidden", lambda f: F.lower(t).contains(f)))
    claims = F.forall("claims", lambda q: F.element_at("references", q["reference"]).isNotNull() & (F.element_at("references", q["reference"]) == q["value"]))
    inside = F.forall(F.map_entries("parameters"), lambda p: F.element_at("space", p["key"]).isNotNull() & p["value"].between(F.element_at("space", p["key"])["low"], F.element_at("space", p["key"])["high"]))
    checks = [
        (None, "study_development_open", c("attempt_status") == "reserved"), (None, "input_identities_match", c("ids") == c("expected")), (None, "tool_results_exact", F.array_sort("tool_results") == F.array_sort("round_results")),
        (None, "rounds_chained", chain), (None, "terminal_artifact_hash_bound", F.length("artifact_hash") == 64), (None, "content_hash_recomputes", _same(c("content_hash"), c("recomputed_hash"))), (None, "forbidden_content_absent", clean),
        (proposal, "evidence_citations_valid", within("citations", "retrieved") & within("counter_citations", "retrieved")), (proposal, "evidence_roles_disjoint", ~F.arrays_overlap("citations", "counter_citations")),
        (proposal, "counterevidence_challenged", (F.size("searches") > 0) & within("searches", "queries")), (proposal, "quantitative_claims_bound", claims), (proposal, "study_scope_matches", c("scope") == c("study_scope")),
        (proposal, "required_inputs_catalogued", within("inputs", "catalogue")), (proposal, "template_permitted", F.array_contains("templates", c("template"))), (proposal, "parameters_in_frozen_space", inside),
        (proposal, "required_controls_retained", within("required_controls", "controls")), (proposal, "limitations_and_failure_conditions_present", F.forall("conditions", lambda x: F.size(x) > 0)),
        (proposal, "point_in_time_reentry_required", c("latest_available") <= c("cutoff")), (abstention, "abstention_queries_attempted", within("searches", "queries")),
        (abstention, "abstention_missing_inputs_consistent", (c("reason") != "missing_input") | ((F.size("missing_inputs") > 0) & (F.size(F.array_except("missing_inputs", "catalogue")) > 0)))]
    return proposals.withColumn("failed", rule_flags(*((name, _fails(ok) if of is None else of & _fails(ok)) for of, name, ok in checks)))
