"""Vocabulary and thresholds, passed to every operator as data."""

from __future__ import annotations

from dataclasses import dataclass, field

# The default event vocabulary of the analysed product.
AGENT_EVENTS = (
    "agent_tool_call_create_block_tool",
    "agent_tool_call_run_block_tool",
    "agent_tool_call_get_block_tool",
    "agent_tool_call_get_canvas_summary_tool",
    "agent_tool_call_get_variable_preview_tool",
    "agent_tool_call_finish_ticket_tool",
    "agent_tool_call_refactor_block_tool",
    "agent_tool_call_delete_block_tool",
    "agent_tool_call_create_edges_tool",
    "agent_tool_call_get_block_image_tool",
    "agent_new_chat",
    "agent_message",
    "agent_start_from_prompt",
    "agent_worker_created",
    "agent_block_created",
    "agent_accept_suggestion",
    "agent_open",
    "agent_block_run",
    "agent_suprise_me",
    "agent_upload_files",
    "agent_open_error_assist",
)
PRODUCTION_EVENTS = (
    "app_publish",
    "app_unpublish",
    "scheduled_job_start",
    "scheduled_job_stop",
    "run_all_blocks",
    "run_block",
    "run_upto_block",
    "run_from_block",
    "requirements_build",
    "hosted_apps_open",
)
COLLAB_EVENTS = ("canvas_share", "resource_shared", "link_clicked")
CREDIT_EVENTS = (
    "credits_used",
    "addon_credits_used",
    "promo_code_redeemed",
    "credits_below_1",
    "credits_below_2",
    "credits_below_3",
    "credits_below_4",
    "credits_exceeded",
)
CANVAS_EVENTS = (
    "canvas_create",
    "canvas_open",
    "canvas_delete",
    "block_create",
    "block_delete",
    "block_rename",
    "block_copy",
    "block_paste",
    "edge_create",
    "edge_delete",
)
SIGNUP_EVENTS = ("sign_up", "new_user_created")


@dataclass(frozen=True)
class Taxonomy:
    """Which event names count as what. Replace the names to analyse another product."""

    agent: tuple[str, ...] = AGENT_EVENTS
    production: tuple[str, ...] = PRODUCTION_EVENTS
    collab: tuple[str, ...] = COLLAB_EVENTS
    credit: tuple[str, ...] = CREDIT_EVENTS
    canvas: tuple[str, ...] = CANVAS_EVENTS
    signup: tuple[str, ...] = SIGNUP_EVENTS
    account_created: str = "sign_up"
    published: str = "app_publish"
    scheduled: str = "scheduled_job_start"
    shared: str = "canvas_share"
    addon: str = "addon_credits_used"
    upgrade: tuple[str, ...] = ("credits_exceeded", "addon_credits_used")
    opened_canvas: str = "canvas_open"
    created_block: str = "block_create"

    def categories(self) -> dict[str, tuple[str, ...]]:
        return {
            "agent": self.agent,
            "production": self.production,
            "collab": self.collab,
            "credit": self.credit,
            "canvas": self.canvas,
        }


@dataclass(frozen=True)
class Settings:
    """Every threshold of the analysis; the defaults are the published ones."""

    taxonomy: Taxonomy = field(default_factory=Taxonomy)
    dedupe: bool = True
    # "continuous" numbers weeks from a fixed Monday, so offsets survive New Year;
    # "iso" uses the bare ISO week number.
    week_mode: str = "continuous"

    first_week_days: int = 7
    early_days: int = 3
    curve_days: int = 30
    agent_hours: tuple[float, float] = (2, 24)
    value_hours: tuple[float, float, float] = (1, 24, 72)
    score_weights: tuple[float, float, float] = (0.40, 0.35, 0.25)
    success_quantile: float = 0.70
    top_events: int = 20
    min_group_users: int = 20
    min_cohort_users: int = 10
    max_week_offset: int = 12
    return_weeks: int = 2
    diverse_event_types: int = 10
    retained_days: int = 7
    one_time_events: int = 5
    risk_cutoffs: tuple[float, float] = (0.3, 0.6)
    recovery_milestones: int = 4
    recovery_share: float = 0.10
    test_share: float = 0.2
    folds: int = 5
    seed: int = 42
    # Candidate limits per feature, and depths of the compared models. More bins come nearer to
    # trying every distinct value and cost memory and time in proportion.
    tree_bins: int = 256
    forest_depth: int = 10
    boosting_depth: int = 3

    # Physical limits, see README "Scale".
    broadcast_people_rows: int = 1_000_000
    rows_per_slice: int = 5_000_000

    def __post_init__(self) -> None:
        if self.week_mode not in ("continuous", "iso"):
            raise ValueError(f"unknown week_mode {self.week_mode!r}")
