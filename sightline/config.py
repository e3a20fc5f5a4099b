"""Settings: defaults, merging, checks, and what follows from them. All driver-side; values become literals of the plan."""

from __future__ import annotations

import copy
import json
import re
from pathlib import Path
from typing import Any

# The defaults that decisions depend on.
DEFAULTS: dict[str, Any] = {
    "detector": {"max_det": 120, "iou": 0.55},
    "selection_filters": {
        "enable_safe_zone": True, "safe_zone_percent": 12, "min_height_ratio": 0.15, "min_box_height_px": 220,
        "conf_threshold": 0.33, "keypoint_conf": 0.30, "min_keypoints": 4, "require_frontal_face": False,
        "min_sharpness_threshold": 80, "premium_min_sharpness": 180,
        "hard_reject_fence": True, "hard_reject_extreme_blur": True,
    },
    "full_frame_runner": {
        "enabled": True, "trigger_box_height_ratio": 0.70, "trigger_box_area_ratio": 0.34,
        "bypass_safe_zone": True, "bypass_min_keypoints": True, "crop_to_aspect_ratio": True,
    },
    "crop": {
        "aspect_ratio": 0.666, "vertical_trim_top_fraction": 0.25, "anatomy_headroom_ratio": 0.08, "anatomy_footroom_ratio": 0.06,
        "anatomy_crown_allowance": 0.06, "anatomy_side_margin": 0.12, "anatomy_shank_to_torso_ratio": 0.75,
        "anatomy_leg_to_torso_ratio": 1.55, "anatomy_knee_extend_ratio": 0.20, "anatomy_hip_extend_ratio": 0.45,
    },
    "completeness_guard": {
        "enabled": True, "require_upper_body": True, "require_lower_body": True, "truncation_guard": True,
        "edge_margin_px": 6, "edge_truncation_guard": True, "review_on_partial": True, "head_estimate_ratio": 0.22,
    },
    "fence_detection": {
        "enabled": True, "bright_threshold": 210, "vertical_kernel_height_ratio": 0.11, "min_component_height_ratio": 0.32,
        "max_component_width_ratio": 0.11, "min_component_aspect_ratio": 3.0, "central_band_width_ratio": 0.58,
        "reject_vertical_line_count": 5, "reject_person_occlusion_coverage": 0.13,
        "reject_central_occlusion_score": 0.22, "reject_vertical_line_coverage": 0.15,
    },
    "whole_image_fallback": {"enabled": False, "min_original_sharpness": 95, "reject_if_fence": True, "save_class": "review"},
    "review_enhancement": {
        "candidate_max_sharpness": 160, "candidate_min_brightness": 60, "candidate_max_brightness": 195,
    },
    "image_quality": {
        "target_height": 4000, "ai_upscaling_limit": 1200, "post_process_premium": False,
        "enhance_by_class": {"premium": "upscale", "good": "upscale", "review": "none"},
    },
    "quality_scoring": {
        "save_review": False, "premium_only": False, "hard_reject_below_score": 62,
        "classes": {"premium": 73, "good": 60, "review": 45},
        "excellent_sharpness": 350, "ideal_runner_height_px": 700, "ideal_confidence": 0.65,
        "weights": {"sharpness": 0.30, "center": 0.12, "size": 0.16, "keypoints": 0.12, "isolation": 0.08, "confidence": 0.10, "fence_free": 0.12},
    },
    "performance": {"fast_path": True},
    "debug": {"save_rejects": False},
    "pre_check": {"enabled": True, "min_image_sharpness": 50.0, "min_image_brightness": 30.0, "max_image_brightness": 230.0},
}
FOLDERS = {"premium": "A_Premium", "good": "B_Good", "review": "C_Review", "reject": "Rejected"}


def merged(over: dict[str, Any] | None, base: dict[str, Any] = DEFAULTS) -> dict[str, Any]:
    """A fresh copy of ``base`` with ``over`` laid on it, section by section."""
    out = copy.deepcopy(base)
    for key, value in (over or {}).items():
        both = isinstance(value, dict) and isinstance(out.get(key), dict)
        out[key] = merged(value, out[key]) if both else copy.deepcopy(value)
    return out


def load(path: str | None) -> dict[str, Any]:
    """Settings of a JSON file over the defaults; the defaults where there is no file."""
    if path is None or not Path(path).exists():
        return merged(None)
    return merged(json.loads(Path(path).read_text(encoding="utf-8")))


def resolved(path: str, base: str) -> str:
    """A stripped path; relative ones start at ``base``, URIs and absolute paths stay, ``C:name`` is an error."""
    path = path.strip()
    if re.match(r"^[A-Za-z]:(?![\\/])", path):
        raise ValueError(f"a drive without a folder: {path}")
    absolute = path.startswith(("/", "\\")) or re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:[\\/]", path)
    return path if absolute else f"{base.rstrip('/')}/{path}"


def saveable_floor(s: dict[str, Any]) -> float | None:
    """The least score that may be saved; None if there is no such line.

    The least line over the classes that are kept, so that lines in an unusual order are safe.
    """
    q = s["quality_scoring"]
    if q["premium_only"]:
        return float(q["classes"]["premium"])
    return None if q["save_review"] else float(min(q["classes"]["good"], q["classes"]["premium"]))


def may_prune(s: dict[str, Any]) -> bool:
    """Whether skipping candidates early can't change what is saved."""
    on = s["performance"]["fast_path"] and not s["debug"]["save_rejects"]
    return bool(on and saveable_floor(s) is not None and all(w >= 0 for w in s["quality_scoring"]["weights"].values()))


def session_settings(cores: int, memory_gb: float, input_gb: float) -> dict[str, str]:
    """Spark settings for a cluster of so many cores and so much executor memory a core, and an input of a size.

    Shuffle partitions hold about 128 MB, and each core gets two at least; batches to
    Python are small where cores have little memory.
    """
    partitions = max(2 * cores, int(input_gb * 1024 / 128))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": "128m",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000" if memory_gb >= 4 else "2000",
    }
