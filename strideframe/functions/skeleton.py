"""Joint layouts: which slot of a keypoint array holds which joint, and the bones between slots."""

from __future__ import annotations

from dataclasses import dataclass, field

# The order of the 59 joints and the limb pairs of the body.
BODY = (
    "nose left_eye right_eye left_ear right_ear left_shoulder right_shoulder left_elbow right_elbow "
    "left_wrist right_wrist left_hip right_hip left_knee right_knee left_ankle right_ankle"
).split()
FINGERS = ["thumb", "index", "middle", "ring", "pinky"]
HAND = ["wrist_hand"] + [f"{f}_{i}" for f in FINGERS for i in range(1, 5)]
BODYPARTS = BODY + [f"{side}_{part}" for side in ("left", "right") for part in HAND]
BODY_BONES_ONE_BASED = [
    (16, 14), (14, 12), (17, 15), (15, 13), (12, 13), (6, 12), (7, 13), (6, 7), (6, 8), (7, 9),
    (8, 10), (9, 11), (2, 3), (1, 2), (1, 3), (2, 4), (3, 5), (4, 6), (5, 7),
]
HIDDEN = {f"{side}_{joint}" for side in ("left", "right") for joint in ("hip", "knee", "ankle")}
LEG_SUFFIXES = ("knee", "ankle")


def hand_bones(root: int) -> list[tuple[int, int]]:
    """Bones of one hand, in solve order; ``root`` is its wrist slot."""
    out = []
    for finger in range(5):
        chain = [root] + [root + 1 + 4 * finger + i for i in range(4)]
        out += list(zip(chain, chain[1:]))
    return out


def bones(names: list[str] = BODYPARTS, legs: bool = False) -> list[tuple[int, int]]:
    """0-based bones of the full skeleton in solve order; bones that touch a knee or an ankle only with ``legs``."""
    every = [(a - 1, b - 1) for a, b in BODY_BONES_ONE_BASED] + hand_bones(17) + hand_bones(38)
    return [(a, b) for a, b in every if legs or not any(names[x].endswith(LEG_SUFFIXES) for x in (a, b))]


def mirrored(name: str) -> str:
    """The name of the joint on the other side of the body."""
    if name.startswith("left_"):
        return "right_" + name[5:]
    return "left_" + name[6:] if name.startswith("right_") else name


def bone_name(a: str, b: str) -> str:
    return f"{a}-{b}"


def mirror_key(a: str, b: str) -> str:
    """Left and right bones share the lesser of both names."""
    return min(bone_name(a, b), bone_name(mirrored(a), mirrored(b)))


@dataclass(frozen=True)
class Layout:
    """Slots of the joints that the kinematic signals read."""

    names: tuple[str, ...]
    dims: int
    tips: tuple[str, ...] = ("thumb", "index", "middle", "ring", "pinky")
    tip_suffix: str = "_4"
    pairs: tuple[str, ...] = field(default=())

    def slot(self, name: str) -> int:
        return self.names.index(name)

    def tip(self, side: str, finger: str) -> int:
        return self.slot(f"{side}_{finger}{self.tip_suffix}")

    def matching(self) -> list[tuple[int, int]]:
        """Left and right slots of the hand landmarks."""
        return [(self.slot(f"left_{x}"), self.slot(f"right_{x}")) for x in self.pairs]


FULL_2D = Layout(tuple(BODYPARTS), 2, pairs=tuple(HAND))
FULL_3D = Layout(tuple(BODYPARTS), 3, pairs=tuple(HAND))
_CORE = [f"{s}_{j}" for j in ("shoulder", "elbow", "wrist", "wrist_hand") for s in ("left", "right")]
#: 21 slots: shoulders, elbows, wrists, hand roots, ten fingertips, three spare.
SMALL_2D = Layout(
    tuple(_CORE + [f"{s}_{f}_4" for s in ("left", "right") for f in FINGERS] + ["spare_0", "spare_1", "spare_2"]),
    2, pairs=("wrist_hand", *(f"{f}_4" for f in FINGERS)),
)
#: 16 slots with depth: shoulders, elbows, wrists, hand roots, thumb, index and pinky tips, two spare.
SMALL_3D = Layout(
    tuple(_CORE + [f"{s}_{f}_4" for s in ("left", "right") for f in ("thumb", "index", "pinky")] + ["spare_0", "spare_1"]),
    3, tips=("thumb", "index", "pinky"), pairs=("wrist_hand", "thumb_4", "index_4", "pinky_4"),
)


def signal_names(dims: int) -> list[str]:
    """Signals in the order of the feature table."""
    axes = "xyz"[:dims]
    names = ["wrist_distance", "lr_keypoint_distance"] + [f"hand_speed_{a}" for a in axes] + [f"hand_accel_{a}" for a in axes]
    names += ["hand_opening", "index_thumb_distance", "thumb_pinky_distance", "hand_y_position"]
    return names + (["elbow_angle", "hand_shoulder_distance"] if dims == 3 else [])


def feature_names(dims: int) -> list[str]:
    return [f"{s}_{k}" for s in signal_names(dims) for k in ("mean", "std")]


def dtw_channels(dims: int) -> list[str]:
    """Channels of gesture matching: every signal but the accelerations along x and y."""
    return [s for s in signal_names(dims) if s not in ("hand_accel_x", "hand_accel_y")]
