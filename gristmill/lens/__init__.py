"""The authority layer: which columns and rows a party may refer to, and rules rewritten to keep to them."""

from gristmill.lens.gate import check_rule_against_lens, describe_rule, lens_required_bindings, resolve_lens_bindings, validate_bind_names
from gristmill.lens.narrowing import validate_narrowing
from gristmill.lens.policy import Lens, Narrowing, Visit, resolve_visit, walk_lens_path
from gristmill.lens.rewrite import apply_lens, stamp_coercions
from gristmill.lens.sources import option_frames, options_from_flat, options_from_rows
from gristmill.lens.surface import exposed_surface, project_by_path

create_lens = Lens
__all__ = [
    "Lens", "Narrowing", "Visit", "apply_lens", "check_rule_against_lens", "create_lens", "describe_rule", "exposed_surface", "lens_required_bindings", "option_frames", "options_from_flat", "options_from_rows",
    "project_by_path", "resolve_lens_bindings", "resolve_visit", "stamp_coercions", "validate_bind_names", "validate_narrowing", "walk_lens_path",
]
