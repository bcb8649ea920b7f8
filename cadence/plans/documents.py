"""The whole document of an edit from its brief: canvas, strategy, beats with what each asks for, captions, sound, effects, variants and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.functions import scalars as S
from cadence.plans.staged import bounded_duration, timeline

#: Where an archetype cuts and what its sound puts first; the first is for all that are not known.
ARCHETYPES = {
    "talking_head": ("cut where the thought or the face changes; show something else only to explain it", "the voice leads, music stays low under it"),
    "tutorial": ("begin with the result; cut between steps that can be seen, rest after each", "a clear voice, small sounds for actions, no music over a step"),
    "product_ugc": ("problem, use, proof, doubt, request; leave the person natural", "the person's own voice; rights and claims are checked"),
    "reaction": ("keep the build-up and the moment of the reaction whole; cut where the feeling turns", "the reaction is heard; few other sounds"),
    "dance_music": ("cut on a movement or beat that means something; keep the body readable", "the track leads; its rights are checked"),
    "montage": ("each picture adds something; vary the size of shots, not only their speed", "music carries it; natural sound at a few places"),
}
PLATFORMS = {
    "tiktok": "the interface covers the right side and the foot; check sound rights for business accounts",
    "instagram_reels": "the grid crops the cover; text stays in the middle",
    "youtube_shorts": "the title covers the foot; a replay begins at once, so the end may lead to the beginning",
}
ELSEWHERE = "look at the current preview, what the interface covers, rights and what the figures mean there"

#: What a beat asks for: material, cut, text, sound, effect, and how it is told that it works. {cut}, {sound}, {hook} and {cta} are the brief's.
BEATS = {
    "hook": ("the strongest {hook} picture, line, face or action", "begin in motion or at the result, without greeting or logo", "one promise or question", "the first natural sound; music does not cover the first words", "none; the motion is in the picture", "the first frame says why to go on"),
    "promise": ("the shortest line that says what is gained, asked or at odds", "only pauses that are accidents are shortened", "a line that makes the promise clear", "the voice leads, music gives way", "a slight move in, if it helps to look", "the promise is the one that is kept later"),
    "proof": ("the first evidence: a result, before and after, the deciding action", "{cut}", "a label where it helps to understand", "{sound}", "another picture only if it leads the eye", "evidence is seen, not only claimed"),
    "progression": ("steps, turns, reactions and examples that go on with the promise", "the picture changes every few seconds, but where the sense does", "captions of one or two lines, short labels", "the voice stays clear, music is moderate", "each orients, explains, stresses, hides a cut or belongs to the brand", "every few seconds something new happens"),
    "payoff": ("the result or the point", "it is given time", "one request: {cta}", "the sound comes to rest", "no end card unless it is needed", "it answers the first promise"),
    "payoff_cta": ("the strongest result, the summary or what to do next", "no long end card; one clear action after the value", "the result and one request: {cta}", "the mix comes to rest, the last words are clear", "nothing covers the result", "the promise is kept before the request"),
}
FIELDS = ("source_request", "edit", "text", "audio", "effect", "acceptance_test")

CANVAS = {"aspect_ratio": "9:16", "resolution": "1080x1920", "safe_zone": "face, product, lines and result stand in the middle, clear of the interface", "frame_rate": "the source's, if it can be kept"}
CAPTIONS = ("said as it is heard, when it is heard", "one or two lines, high contrast, clear of the interface", "12 to 17 characters a second; 18 to 20 only for simple sentences", "title, subtitles, labels and request are told apart")
SOUND = {"loudness": "-16 LUFS, give or take 2, to begin with", "true_peak": "-1 dBTP at most", "ducking": "music 12 to 18 dB below speech to begin with"}
LISTEN = ("the speaker of a phone", "low volume", "headphones", "one channel", "rights on each platform")
ROLES = ("orient", "explain", "emphasize", "hide_cut", "emotion", "brand")
VARIANTS = (("hook_A", "begins with the result", "body, mix and request"), ("hook_B", "begins with a question", "body, mix and request"), ("pace_slow", "a quarter slower", "hook, words and result"), ("audio_clean", "less music, or none", "pictures, hook and captions"))
CHECKS = (
    "the first frame says why to go on", "the promise is kept before the request", "cuts follow the sense", "captions are right, legible and clear of the interface", "the voice is clear on a small speaker",
    "nothing clips; loudness and true peak are measured after export", "music, pictures, voice and claims may be used there", "every effect has a role",
)
READY = "words with their times and the chosen material are there"


def _texts(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _by(column: Column, table: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for name, text in table.items():
        out = F.when(column == name, text).otherwise(out)
    return out


def edit_document(briefs: DataFrame) -> DataFrame:
    """Briefs with ``document``: a struct of all that an editor is told. What a brief leaves out: result_first as hook, no request, speech and music,
    captions where there is speech, 20 seconds, retention as objective; an unknown archetype is told what a talking head is."""
    have = lambda c, other: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit(other)) if c in briefs.columns else F.lit(other)
    given = lambda c: (F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")).isin("", "[]")) if c in briefs.columns else F.lit(True)
    switch = lambda c, other: S.as_bool(F.col(c), other) if c in briefs.columns else other if isinstance(other, Column) else F.lit(other)
    names = {"platform": F.coalesce(S.platform(have("platform", "tiktok")), F.lit("tiktok")), "objective": have("objective", "retention"), "archetype": have("archetype", "talking_head"), "hook": have("hook_type", "result_first"), "cta": have("cta", "none"), "seconds": bounded_duration(F.col("duration_s"))}
    held = briefs.withColumns({f"__{k}": v for k, v in names.items()} | {"__speech": switch("speech", True), "__music": switch("music", True)}).withColumn("__captions", switch("captions", F.col("__speech")))
    first = next(iter(ARCHETYPES.values()))
    cut, sound = (_by(F.col("__archetype"), {k: v[i] for k, v in ARCHETYPES.items()}, first[i]) for i in (0, 1))
    held = held.withColumns({"__cut": cut, "__sound": sound})

    def told(beat: Column, k: int) -> Column:
        text = _by(beat, {name: parts[k] for name, parts in BEATS.items()}, "")
        for mark in ("cut", "sound", "hook", "cta"):
            text = F.replace(text, F.lit("{" + mark + "}"), F.col(f"__{mark}"))
        return text

    beats = F.transform(timeline(F.col("__seconds")), lambda b: F.struct(F.round(b["start_s"], 3).alias("start_s"), F.round(b["end_s"], 3).alias("end_s"), b["beat"].alias("beat"), *[told(b["beat"], k).alias(f) for k, f in enumerate(FIELDS)]))
    constant = lambda table: F.struct(*[F.lit(v).alias(k) for k, v in table.items()])
    lacking = F.array_compact(F.array(*[F.when(given(c), F.lit(c)) for c in ("source_assets", "transcript_or_timecodes")]))
    document = F.struct(
        F.lit("1").alias("schema_version"),
        F.struct(*[F.col(f"__{k}").alias(n) for k, n in (("platform", "platform"), ("objective", "objective"), ("archetype", "archetype"), ("seconds", "duration_s"), ("hook", "hook_type"), ("cta", "cta"))]).alias("brief"),
        constant(CANVAS).alias("canvas"),
        F.struct(F.col("__cut").alias("cut_policy"), F.col("__sound").alias("audio_priority"), _texts(("result_first", "question_or_conflict", "proof_or_transformation")).alias("hook_alternatives")).alias("strategy"),
        beats.alias("timeline"),
        F.struct(F.col("__captions").alias("enabled"), _texts(CAPTIONS).alias("rules")).alias("captions"),
        F.struct(F.col("__speech").alias("speech"), F.col("__music").alias("music"), F.when(F.col("__speech"), "voice > music > effects").otherwise("music > effects").alias("priority"), *[F.lit(v).alias(k) for k, v in SOUND.items()], _texts(LISTEN).alias("checks")).alias("audio"),
        F.struct(F.lit("cut").alias("default_transition"), _texts(ROLES).alias("roles")).alias("effects"),
        F.array(*[F.struct(F.lit(a).alias("id"), F.lit(b).alias("change"), F.lit(c).alias("hold")) for a, b, c in VARIANTS]).alias("variants"),
        _texts(CHECKS).alias("checks"),
        _by(F.col("__platform"), PLATFORMS, ELSEWHERE).alias("platform_note"),
        F.when(F.size(lacking) > 0, lacking).otherwise(F.array(F.lit(READY))).alias("next_input"),
    )
    return held.select(*briefs.columns, document.alias("document"))


def markdown(document: dict) -> str:
    """One document as text."""
    brief, audio = document["brief"], document["audio"]
    out = ["# Edit", "", *[f"* {k}: {v}" for k, v in brief.items()], "", "## Strategy", "", f"* {document['strategy']['cut_policy']}", f"* {document['strategy']['audio_priority']}", f"* {document['platform_note']}", "", "## Timeline", ""]
    columns = ["start_s", "end_s", "beat", *FIELDS]
    out += ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *["| " + " | ".join(str(b[c]) for c in columns) + " |" for b in document["timeline"]]]
    out += ["", "## Sound", "", *[f"* {k}: {audio[k]}" for k in ("priority", *SOUND)], "", "## Variants", "", *[f"* {v['id']}: {v['change']}; the same: {v['hold']}" for v in document["variants"]]]
    return "\n".join([*out, "", "## Checks", "", *[f"* [ ] {c}" for c in document["checks"]], "", "## Next", "", *[f"* {c}" for c in document["next_input"]]]) + "\n"
