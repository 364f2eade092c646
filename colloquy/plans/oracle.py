"""DuckDB SQL that computes the same results another way.

Examples come from a band self-join, ordinals from plain row numbers, logits
from one row per token, so little of the Spark side's reasoning is shared.
"""

from __future__ import annotations

from colloquy.plans.queries import CONFIG, EOS_LOGIT, PAD_LABEL, WORLD

H, L = CONFIG.max_hist, CONFIG.max_len
FS, BK, BS, SEED = (CONFIG.file_size, CONFIG.bucket_size,
                    CONFIG.batch_size, CONFIG.seed)
SPLIT = ("case when {c} % 10 < 8 then 'train' when {c} % 10 = 8 "
         "then 'valid' else 'test' end")

TOKS = r"""
toks as (select conv_id, turn, text,
           list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') as words
         from conversations)"""

VOCAB = """
pieces as (select conv_id, turn, unnest(words) as token,
             generate_subscripts(words, 1) as pos from toks),
counted as (select token, count(*) as n from pieces
            where token not in ('<unk>','<s>','</s>','<mask>','<sp1>','<sp2>',
                                '<hst>','<rsp>','<pad>') group by token),
vocab as (select token, cast(3 + row_number() over (order by n desc, token) as integer) as id, n
          from counted
          union all select * from (values ('<unk>',0,0),('<s>',1,0),('</s>',2,0),('<mask>',3,0))
          union all select t, cast(4 + i + (select count(*) from counted) as integer), 0
          from (values ('<sp1>',0),('<sp2>',1),('<hst>',2),('<rsp>',3),('<pad>',4)) as s(t, i)),
sp as (select max(id) filter (token = '<sp1>') as sp1, max(id) filter (token = '<sp2>') as sp2,
         max(id) filter (token = '<hst>') as hst, max(id) filter (token = '<rsp>') as rsp,
         max(id) filter (token = '<pad>') as pad from vocab),
enc as (select conv_id, turn, list(id order by pos) as ids
        from pieces join vocab using (token) group by conv_id, turn)"""

INDEX = f"""
lens as (select conv_id, turn, cast(len(words) as bigint) as n,
           sum(len(words) + 1) over (partition by conv_id order by turn
             rows between {H} preceding and 1 preceding) as before,
         from toks),
idx as (select e.conv_id, b.turn as begin_idx, e.turn as end_idx,
          cast(e.before + e.n + 1 as bigint) as example_len, least(e.n, {L}) + 1 as target_len
        from lens e join lens b
          on b.conv_id = e.conv_id and b.turn < e.turn and b.turn >= e.turn - {H}),
sized as (select i.conv_id, i.begin_idx, i.end_idx, i.example_len,
            cast(any_value(i.target_len) as bigint) as target_len,
            cast(2 + any_value(i.target_len) + sum(least(h.n + 1, {L})) as bigint) as input_len
          from idx i join lens h
            on h.conv_id = i.conv_id and h.turn >= i.begin_idx and h.turn < i.end_idx
          group by all)"""

EXAMPLES = f"""
roles as (select i.conv_id, i.begin_idx, i.end_idx, h.turn,
            case when (i.end_idx - 1 - h.turn) % 2 = 0 then sp.sp2 else sp.sp1 end as role, h.ids
          from idx i join enc h on h.conv_id = i.conv_id
            and h.turn >= i.begin_idx and h.turn < i.end_idx, sp),
prompts as (select conv_id, begin_idx, end_idx,
              list(role order by turn) as roles,
              list(list_concat([role], ids)[1:{L}] order by turn) as turns,
              flatten(list(ids order by turn)) as raw
            from roles group by all),
seqs as (select p.*, list_concat([1], flatten(turns), [sp.sp1]) as prompt,
           list_concat(e.ids[1:{L}], [2]) as target_ids, e.ids as target
         from prompts p join enc e on e.conv_id = p.conv_id and e.turn = p.end_idx, sp),
examples as (select conv_id, begin_idx, end_idx,
               list_concat(prompt, target_ids) as input_ids,
               list_concat(list_resize(cast([] as integer[]), len(prompt) - 1, sp.hst),
                           list_resize(cast([] as integer[]), len(target_ids) + 1, sp.rsp))
                 as token_type_ids,
               target_ids, len(prompt) as p from seqs, sp)"""

LAYOUT = f"""
dialogs as (select {SPLIT.format(c='conv_id')} as split, conv_id, count(*) as n_turns
            from conversations group by conv_id),
ranked as (select *, row_number() over (partition by split order by conv_id) - 1 as r from dialogs),
shards as (select split, conv_id, n_turns, r // {FS} as shard, r % {FS} as shard_pos from ranked)"""

ORDERED = f"""
ordinals as (select s.split, s.shard, i.*, row_number() over (
               partition by s.split, s.shard order by s.conv_id, end_idx, begin_idx) - 1 as ordinal
             from sized i join shards s using (conv_id)),
ordered as (select *, row_number() over (partition by split, shard
              order by example_len, ordinal) - 1 as position from ordinals),
bucketed as (select *, position // {BK} as bucket from ordered)"""

DRAWN = f"""
buckets as (select split, shard, bucket, count(*) as n_rows,
              md5(concat_ws(':', {SEED}, 0, split, shard, bucket)) as k
            from bucketed group by all),
starts as (select split, shard, bucket, n_rows, cast(coalesce(sum(n_rows) over (
             partition by split, shard order by k, bucket
             rows between unbounded preceding and 1 preceding), 0) as bigint) as start
           from buckets),
drawn as (select b.*, s.start + row_number() over (partition by b.split, b.shard, b.bucket
            order by case when b.split = 'train'
              then md5(concat_ws(':', {SEED}, 0, conv_id, end_idx, begin_idx)) end,
              position) - 1 as draw
          from bucketed b join starts s using (split, shard, bucket)),
batched as (select *, draw // {BS} as batch from drawn),
planned as (select *, max(input_len) over w as max_seq, max(target_len) over w as max_target
            from batched window w as (partition by split, shard, batch))"""

RENDERED = f"""
lines as (select i.conv_id, i.begin_idx, i.end_idx, string_agg(
            case when (i.end_idx - 1 - h.turn) % 2 = 0 then '<sp2>' else '<sp1>' end
            || ' ' || array_to_string(h.words[1:{L - 1}], ' '), ' ' order by h.turn) as history
          from idx i join toks h on h.conv_id = i.conv_id
            and h.turn >= i.begin_idx and h.turn < i.end_idx group by all),
rendered as (select l.conv_id, begin_idx, end_idx, {SPLIT.format(c='l.conv_id')} as split,
               string_split(history || ' <sp1> ' || array_to_string(t.words[1:{L}], ' '), '<sp1>') as parts
             from lines l join toks t on t.conv_id = l.conv_id and t.turn = l.end_idx),
normal as (select conv_id, begin_idx, end_idx, split,
             trim(replace(array_to_string(parts[:-2], ' '), '<sp2>', ' ')) as input,
             parts[-1] as target from rendered),
predicted as (select conv_id, begin_idx, end_idx, array_to_string(list_filter(
                regexp_split_to_array(input, '\\s+'), lambda w: w <> ''), ' ') as response
              from normal)"""

LOGITS = """
logits as (select vec_id // 4 as seq_id, cast(vec_id % 4 as integer) as pos,
             vec_id // 64 as batch, label as target,
             cast(generate_subscripts(embedding, 1) - 1 as integer) as token_id,
             cast(unnest(embedding) as double) * 10 as logit
           from embeddings)"""

MASKED = f"""
masked as (select seq_id, pos, token_id, case when pos < 2 and token_id = {EOS_LOGIT}
             then cast('-inf' as double) else logit end as logit from logits)"""

NUCLEUS = """
shares as (select *, exp(logit - max(logit) over (partition by seq_id, pos))
             as e from {src}),
probs as (select *, e / sum(e) over (partition by seq_id, pos) as prob from shares),
massed as (select *, coalesce(sum(prob) over (partition by seq_id, pos
             order by logit desc, token_id
             rows between unbounded preceding and 1 preceding), 0) as before from probs),
kept as (select * from massed where before <= 0.9)"""

STEPS = """
steps as (select user_id as run_id,
            cast(date_diff('day', date '2024-01-01', cast(ts as date)) // 5 as integer) as epoch,
            case when event_id % 5 = 0 then 'valid' else 'train' end as split,
            cast(event_id % 4 as integer) as rank, event_id as step, ts,
            case when event_type = 'error' and event_id % 5 <> 0
              then cast('nan' as double) else value / 100 end as loss,
            (event_id % 100) / 100 as acc,
            case when event_type = 'error' and event_id % 5 <> 0 then cast('nan' as double)
              when value / 100 >= 4 then cast('inf' as double) else exp(value / 100) end as ppl
          from events),
good as (select * from steps where not isnan(loss))"""

EPOCHS = """
epochs as (select run_id, epoch, split, avg(loss) as loss, avg(acc) as acc, avg(ppl) as ppl
           from good group by all),
history as (select run_id, epoch,
              max(loss) filter (split = 'train') as train_loss,
              max(acc) filter (split = 'train') as train_acc,
              max(ppl) filter (split = 'train') as train_ppl,
              max(loss) filter (split = 'valid') as valid_loss,
              max(acc) filter (split = 'valid') as valid_acc,
              max(ppl) filter (split = 'valid') as valid_ppl
            from epochs group by run_id, epoch)"""

HISTORY = ("train_loss", "train_acc", "train_ppl", "valid_loss", "valid_acc", "valid_ppl")


def _with(*parts: str) -> str:
    return "with " + ",".join(p.strip("\n") for p in parts) + "\n"


def _text(*lists: str) -> str:
    return ", ".join(f"array_to_string({x}, ' ') as {x}" for x in lists)


def _round(*names: str, places: int = 6) -> str:
    return ", ".join(f"round({n}, {places}) as {n}" for n in names)


KEYS = "conv_id, begin_idx, end_idx"
BATCH = "split, shard, batch"
_EX = _with(TOKS, VOCAB, INDEX, EXAMPLES)
_ORD = _with(TOKS, INDEX, LAYOUT, ORDERED)
_PLAN = _with(TOKS, INDEX, LAYOUT, ORDERED, DRAWN)
_REN = _with(TOKS, INDEX, RENDERED)
_HIST = _with(STEPS, EPOCHS)
_TURNS = f"""select {SPLIT.format(c='conv_id')} as split, conv_id, turn, turn as place, text
  from conversations"""

_COLLATED = _with(TOKS, VOCAB, INDEX, EXAMPLES, LAYOUT, ORDERED, DRAWN, """
rows as (select x.*, p.split, p.shard, p.batch, p.max_seq as m, p.max_target as mt,
           len(x.input_ids) as u, len(x.target_ids) as t, sp.pad
         from examples x join planned p using (conv_id, begin_idx, end_idx), sp),
padded as (select *, list_concat(input_ids, list_resize(cast([] as integer[]), m - u, pad)) as ids,
             list_concat(token_type_ids, list_resize(cast([] as integer[]), m - u, pad)) as types,
             list_concat(list_resize(cast([] as integer[]), u - t, pad), target_ids,
                         list_resize(cast([] as integer[]), m - u, pad)) as labels,
             list_concat(target_ids, list_resize(cast([] as integer[]), mt - t, pad)) as targets,
             repeat('1 ', u) || repeat('0 ', m - u) as seen
           from rows)""")

_SHARES = """
scored as (select *, regexp_split_to_array(response, ' ') as w from predicted
           join normal using (conv_id, begin_idx, end_idx) where split = 'test'),
lowered as (select list_filter(regexp_split_to_array(lower(response), '\\s+'),
              lambda x: x <> '') as w from scored),
paired as (select w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) as p
           from lowered),
measured as (select unnest(['length', 'distinct_1', 'distinct_2']) as metric,
               unnest([cast(len(w) as double),
                 case when len(w) > 0 then len(list_distinct(w)) / len(w) end,
                 case when len(p) > 0 then len(list_distinct(p)) / len(p) end]) as v from paired),
summary as (select metric, avg(v) as mean, stddev_samp(v) as std,
              1.96 * stddev_samp(v) / sqrt(count(v)) as confidence
            from measured where v is not null group by metric)"""

_STOP = _HIST.rstrip() + """,
spent as (select run_id, epoch, sum(count(*) filter (split = 'train')) over (
            partition by run_id order by epoch) as done from good group by run_id, epoch),
validated as (select run_id, epoch, valid_loss, row_number() over (
                partition by run_id order by epoch) as place
              from history where valid_loss is not null),
better as (select v.* from validated v where not exists (
             select 1 from validated e where e.run_id = v.run_id and e.epoch < v.epoch
               and e.valid_loss <= v.valid_loss)),
hits as (select v.run_id, min(v.epoch) as hit from validated v
         where v.place - 3 = coalesce((select max(b.place) from better b
           where b.run_id = v.run_id and b.place <= v.place), 0) group by v.run_id),
stops as (select h.run_id, any_value(hit) as hit, max(h.epoch) as last,
            (select min(epoch) from spent s where s.run_id = h.run_id and done = 25) as budget
          from history h left join hits using (run_id) group by h.run_id)
"""

ORACLES: dict[str, str] = {
    # sources
    "src_jsonl": _TURNS,
    "src_nested_json": f"""
        with t as ({_TURNS})
        select case split when 'test' then 'train' else split end as split,
          conv_id, turn, place, text from t
        union all select 'test', conv_id, turn, place, text from t where split = 'valid'""",
    "src_map_json": _TURNS,
    "src_blankline_text": rf"""
        select {SPLIT.format(c='conv_id')} as split, conv_id, turn, turn as place,
          regexp_replace(regexp_replace(text, '[\r\n]', ' ', 'g'), '\s+$', '') as text
        from conversations""",
    "scan_split": _with(LAYOUT) + """
        select split, shard, conv_id, turn, text from conversations
        join shards using (conv_id) where split = 'valid'""",
    "read_history": _HIST + f"select run_id, epoch, {_round(*HISTORY, places=9)} from history",
    "read_metric_text": _with(TOKS, INDEX, RENDERED, _SHARES) + f"""
        select metric, {_round('mean', 'std', 'confidence')} from summary""",
    # splits and sinks
    "shard_assign": _with(LAYOUT) + "select split, conv_id, shard, shard_pos from shards",
    "split_manifest": _with(TOKS, INDEX) + f"""
        select split, count(distinct conv_id) as n_dialogs,
          cast(sum(examples) as bigint) as n_examples, cast({H} as integer) as max_hist,
          any_value(f) as fingerprint
        from (select {SPLIT.format(c='t.conv_id')} as split, t.conv_id,
                (select count(*) from idx i where i.conv_id = t.conv_id and i.end_idx = t.turn)
                  as examples,
                lpad(cast(cast(list_reduce(list_transform(range(0, 40),
                  lambda i: cast(instr('0123456789abcdef', sha1('{H}{FS}')[i + 1]) - 1 as hugeint)),
                  lambda a, b: (a * 16 + b) % 100000000) as bigint) as varchar), 8, '0') as f
              from toks t) group by split""",
    "config_fingerprint": """
        select conv_id, turn, lpad(cast(list_reduce(list_transform(range(0, 40),
            lambda i: cast(instr('0123456789abcdef', sha1(turn || '' || conv_id)[i + 1]) - 1
                           as bigint)),
            lambda a, b: (a * 16 + b) % 100000000) as varchar), 8, '0') as fingerprint
        from conversations""",
    "eval_table": _REN + f"""
        select {KEYS}, lower(input) as input, lower(target) as target,
          lower(response) as response
        from normal join predicted using ({KEYS}) where split = 'test'""",
    "eval_lines": _REN + f"""
        select lower(input) as input, lower(target) as target, lower(response) as response
        from normal join predicted using ({KEYS}) where split = 'test'""",
    "metric_events": _with(STEPS) + """
        select run_id, case split when 'valid' then 'val' else split end || '/' || metric as tag,
          step, round(case when value = cast('inf' as double) then 1e30 else value end, 6) as value
        from (select run_id, split, step, unnest(['loss', 'acc', 'ppl']) as metric,
                unnest([loss, acc, ppl]) as value from good)""",
    "history_columnar": _HIST + "select run_id, string_agg(epoch, ' ' order by epoch) as epoch, "
        + ", ".join(
            f"string_agg(case when {h} is null then 'none' when isinf({h}) then 'inf' "
            f"else cast(cast(round({h} * 1e6) as hugeint) as varchar) end, "
            f"' ' order by epoch) as {h}" for h in HISTORY) + " from history group by run_id",
    # turns
    "dialog_assemble": """
        select conv_id, min(turn) as first_turn, cast(count(*) as integer) as n_turns,
          string_agg(text, ' | ' order by turn) as utterances
        from conversations group by conv_id""",
    "dense_turns": """
        select conv_id, turn * 7 + conv_id % 5 as source_turn,
          row_number() over (partition by conv_id order by turn) - 1 as turn
        from conversations""",
    "eligible_dialogs": """
        select conv_id, count(*) as n_turns from conversations
        group by conv_id having count(*) >= 2""",
    "normalize_input": _REN + f"select {KEYS}, split, input, target from normal",
    "align_predictions": _REN + f"""
        select {KEYS}, target, response from normal join predicted using ({KEYS})""",
    "history_band_join": f"""
        select e.conv_id, b.turn as begin_idx, e.turn as end_idx
        from conversations e join conversations b on b.conv_id = e.conv_id
          and b.turn < e.turn and b.turn >= e.turn - {H}""",
    "merge_precedence": """
        select conv_id, turn, text,
          case when conv_id % 2 = 0 or conv_id % 3 = 0 then 'freq' else 'rare' end as source
        from conversations""",
    "split_overlap": f"""
        with turns as (select {SPLIT.format(c='conv_id')} as split, * from conversations),
        items as (
          select 'turn' as level, split, lower(text) as item from turns union all
          select 'dialog', split, string_agg(turn || ':' || text, chr(1) order by turn)
          from turns group by split, conv_id),
        spread as (select level, item, count(distinct split) as n from items group by all)
        select level, split, count(distinct item) as n_items,
          count(distinct item) filter (n > 1) as n_shared
        from items join spread using (level, item) group by level, split""",
    "context_window": f"""
        select conv_id, turn, array_to_string(list(text) over (partition by conv_id order by turn
          rows between {H - 1} preceding and current row), ' | ') as context
        from conversations""",
    "take_n": _with(TOKS, INDEX) + f"""
        select example_len, {KEYS} from idx order by all limit 25""",
    # vocabulary
    "build_vocab": _with(TOKS, VOCAB) + "select token, id, n from vocab",
    "encode_tokens": _with(TOKS, VOCAB) + f"select conv_id, turn, {_text('ids')} from enc",
    "decode_tokens": _with(TOKS) + """
        select conv_id, turn, array_to_string(words, ' ') as text from toks""",
    "strip_special": _with(TOKS, INDEX) + f"""
        , parts as (select i.{KEYS.replace(', ', ', i.')}, h.turn,
                      array_to_string(case when h.turn = i.end_idx then h.words[1:{L}]
                        else h.words[1:{L - 1}] end, ' ') as part
                    from idx i join toks h on h.conv_id = i.conv_id
                      and h.turn between i.begin_idx and i.end_idx)
        select {KEYS}, string_agg(part, ' ' order by turn) as text from parts group by {KEYS}""",
    "word_vocab": _REN + r"""
        select distinct word from (
          select unnest(regexp_split_to_array(lower(input), '\s+')) as word
          from normal where split in ('train', 'test') union all
          select unnest(regexp_split_to_array(lower(target), '\s+'))
          from normal where split = 'test') where word <> ''""",
    # examples
    "example_index": _with(TOKS, INDEX) + f"""
        select {KEYS}, example_len, input_len, target_len from sized""",
    "example_len": _with(TOKS, INDEX) + """
        select conv_id, turn as end_idx, cast(before + n + 1 as bigint) as example_len
        from lens where turn >= 1""",
    "example_lookup": _EX + f"""
        select {KEYS}, array_to_string(raw, ' ') as history, {_text('target')} from seqs""",
    "speaker_roles": _EX + f"select {KEYS}, {_text('roles')} from seqs",
    "truncate_turns": _EX + f"""
        select {KEYS}, array_to_string(list_transform(turns,
          lambda t: array_to_string(t, ' ')), ' | ') as turns from seqs""",
    "input_sequence": _EX + f"""
        select {KEYS}, array_to_string(prompt, ' ') as input_ids from seqs""",
    "token_types": _EX + f"""
        select {KEYS}, repeat(sp.hst || ' ', len(prompt) - 1) || sp.rsp as token_type_ids
        from seqs, sp""",
    "target_sequence": _with(TOKS, VOCAB) + f"""
        select conv_id, turn as end_idx,
          array_to_string(list_concat(ids[1:{L}], [2]), ' ') as target_ids
        from enc where turn >= 1""",
    "build_examples": _EX + f"""
        select {KEYS}, example_len, {_text('input_ids', 'token_type_ids', 'target_ids')}
        from examples join idx using ({KEYS})""",
    "truncate_at_eos": _with(TOKS, VOCAB) + f"""
        select conv_id, turn, array_to_string(
          ids[1:least({L}, coalesce(list_position(ids, 4), 1000000) - 1)], ' ') as ids from enc""",
    "extend_inputs": _EX + f"""
        select {KEYS},
          array_to_string(list_concat(prompt, target, [3]), ' ') as input_ids,
          repeat(sp.hst || ' ', len(prompt) - 1)
            || array_to_string(list_resize(cast([] as integer[]), 2 + len(target), sp.rsp), ' ')
            as token_type_ids
        from seqs, sp""",
    # batches
    "length_order": _ORD + f"select split, shard, {KEYS}, example_len, position from ordered",
    "bucket_assign": _ORD + f"select split, shard, {KEYS}, bucket from bucketed",
    "bucket_shuffle": _PLAN + "select split, shard, bucket, n_rows, start from starts",
    "in_bucket_shuffle": _PLAN + f"select split, shard, {KEYS}, bucket, draw from drawn",
    "batch_assign": _PLAN + f"select {BATCH}, {KEYS}, draw from batched",
    "batch_max_len": _PLAN + f"""
        select {BATCH}, {KEYS}, input_len, max_seq, max_target from planned""",
    "padding_budget": _PLAN + f"""
        select {BATCH}, count(*) as n_rows, max(input_len) as max_seq,
          cast(sum(input_len) as bigint) as used_cells,
          count(*) * max(input_len) as cells,
          cast(count(*) * max(input_len) - sum(input_len) as bigint) as wasted_cells,
          cast({BS} * (({L} + 1) * {H} + 1 + {L} + 1) as bigint) as worst_cells
        from planned group by {BATCH}""",
    "rank_shard": _ORD.rstrip() + f""",
        counts as (select split, shard, count(*) as n from ordinals group by all),
        places as (select split, shard, n, unnest(range(0,
                     cast(ceil(n / {WORLD}) * {WORLD} as bigint))) as place from counts),
        dealt as (select o.*, place // {WORLD} as slot, cast(place % {WORLD} as integer) as rank
                  from places p join ordinals o on o.split = p.split and o.shard = p.shard
                    and o.ordinal = p.place % p.n)
        select split, shard, rank, {KEYS}, row_number() over (
          partition by split, shard, rank order by example_len, slot) - 1 as position
        from dealt""",
    "num_steps": _ORD.rstrip() + f""",
        per_shard as (select split, shard, count(*) as n from ordinals group by all)
        select split, cast(sum(n) as bigint) as n_examples,
          cast(ceil(sum(n) / {BS}) as bigint) as n_steps,
          cast(sum(ceil(n / {BS})) as bigint) as n_batches
        from per_shard group by split""",
    "collate_causal": _COLLATED + f"""
        select {BATCH}, {KEYS}, array_to_string(ids[:m - 1], ' ') as input_ids,
          array_to_string(types[:m - 1], ' ') as token_type_ids,
          array_to_string(labels[2:], ' ') as labels from padded""",
    "collate_causal_eval": _COLLATED + f"""
        select {BATCH}, {KEYS}, array_to_string(ids, ' ') as input_ids,
          array_to_string(types, ' ') as token_type_ids from padded""",
    "collate_permuted": _COLLATED + f"""
        select {BATCH}, {KEYS}, array_to_string(ids, ' ') as input_ids,
          array_to_string(types, ' ') as token_type_ids,
          array_to_string(targets, ' ') as labels, trim(seen) as attention_mask from padded""",
    "collate_permuted_eval": _COLLATED + f"""
        select {BATCH}, {KEYS}, array_to_string(ids, ' ') as input_ids,
          trim(seen) as attention_mask, cast(m as integer) as mask_rows,
          repeat('0', u - 1) || repeat('1', m - u + 1) as mask_row,
          repeat('0', u - 1) || '1' || repeat('0', m - u) as target_map from padded""",
    "perm_mask": _PLAN + f"""
        select {KEYS}, cast(r as integer) as row, case when r >= input_len
            then repeat('1', max_seq)
            else repeat('0', greatest(r, input_len - target_len - 1))
              || repeat('1', max_seq - greatest(r, input_len - target_len - 1)) end as bits
        from (select *, unnest(range(0, max_seq)) as r from planned)""",
    "target_map": _PLAN + f"""
        select {KEYS}, cast(r as integer) as row, case when r >= target_len
            then repeat('0', max_seq)
            else repeat('0', input_len - target_len + r) || '1'
              || repeat('0', max_seq - input_len + target_len - r - 1) end as bits
        from (select *, unnest(range(0, max_target)) as r from planned)""",
    # scores
    "log_softmax": _with(LOGITS) + """
        select seq_id, pos, token_id, round(logit - top - ln(sum(exp(logit - top)) over (
            partition by seq_id, pos)), 6) as log_prob
        from (select *, max(logit) over (partition by seq_id, pos) as top from logits)""",
    "argmax_token": _with(LOGITS) + """
        select seq_id, pos, arg_min(token_id, (-logit, token_id)) as token_id
        from logits group by seq_id, pos""",
    "token_metrics": _with(LOGITS) + f"""
        , tops as (select seq_id, pos, batch, target, max(logit) as top,
                     arg_min(token_id, (-logit, token_id)) as best from logits group by all),
        nll as (select t.batch, t.target, t.best, ln(sum(exp(logit - top))) + any_value(top)
                  - any_value(logit) filter (token_id = t.target) as nll
                from logits l join tops t using (seq_id, pos) where t.target <> {PAD_LABEL}
                group by seq_id, pos, t.batch, t.target, t.best)
        select batch, count(*) as n_targets, round(avg(nll), 6) as loss,
          round(avg(cast(best = target as integer)), 6) as acc, round(exp(avg(nll)), 6) as ppl
        from nll group by batch""",
    "min_len_mask": _with(LOGITS, MASKED) + """
        select seq_id, pos, token_id, round(logit, 6) as logit from masked""",
    "topk_filter": _with(LOGITS) + """
        , kept as (select * from logits qualify rank() over (
            partition by seq_id, pos order by logit desc) <= 10)
        select seq_id, pos, token_id, round(logit, 6) as logit,
          round(exp(logit) / sum(exp(logit)) over (partition by seq_id, pos), 6) as prob
        from kept""",
    "nucleus_filter": _with(LOGITS, NUCLEUS.format(src="logits")) + """
        select seq_id, pos, token_id, round(logit, 6) as logit,
          round(prob / sum(prob) over (partition by seq_id, pos), 6) as prob from kept""",
    "sample_token": _with(LOGITS, MASKED, NUCLEUS.format(src="masked")) + f"""
        , final as (select *, sum(prob) over (partition by seq_id, pos order by logit desc, token_id
                      rows unbounded preceding) / sum(prob) over (partition by seq_id, pos) as upto,
                      (cast('0x' || md5(concat_ws(':', {SEED}, seq_id, pos))[:8] as bigint) + 0.5)
                        / 4294967296 as u from kept)
        select seq_id, pos, arg_max(token_id, (logit, -token_id)) as token_id
        from final where upto >= u group by seq_id, pos""",
    # metrics
    "nan_skip": _with(STEPS) + """
        select run_id, epoch, count(*) filter (not isnan(loss)) as n_steps,
          count(*) filter (isnan(loss)) as n_skipped from steps group by run_id, epoch""",
    "epoch_metrics": _with(STEPS, EPOCHS) + """
        select run_id, epoch, split, round(loss, 9) as loss, round(acc, 9) as acc,
          case when isinf(ppl) then 1e30 else round(ppl, 9) end as ppl from epochs""",
    "inf_clamp": _with(STEPS) + """
        select run_id, split, step,
          round(case when isinf(ppl) then 1e30 else ppl end, 6) as ppl from good""",
    "rank_mean": _with(STEPS) + """
        , numbered as (select run_id, epoch, split, loss, acc, row_number() over (
              partition by run_id, epoch, split order by step) - 1 as number from good)
        select run_id, epoch, split, number // 4 as step,
          round(sum(loss) / count(*), 9) as loss, round(sum(acc) / count(*), 9) as acc
        from numbered group by all""",
    "best_epoch": _STOP + """
        select run_id, max(epoch) as best_epoch,
          round(arg_max(valid_loss, epoch), 6) as best_valid_loss
        from better group by run_id""",
    "early_stop": _STOP + """
        select run_id, coalesce(least(hit, budget), last) as last_epoch,
          (select max(epoch) from better b where b.run_id = s.run_id
             and b.epoch <= coalesce(least(s.hit, s.budget), s.last)) as best_epoch,
          case when hit is not null and (budget is null or hit <= budget) then 'patience'
            when budget is not null then 'budget' else 'finished' end as reason
        from stops s""",
    "metric_summary": _with(TOKS, INDEX, RENDERED, _SHARES) + f"""
        select metric, {_round('mean', 'std', 'confidence')} from summary""",
    # the streams' results once all input is in
    "stream_context": f"""
        select conv_id, turn, array_to_string(list(text) over (partition by conv_id order by turn
          rows between {H - 1} preceding and current row), ' | ') as context
        from conversations""",
    "stream_metrics": """
        select user_id as run_id,
          cast(date_diff('day', date '2024-01-01', cast(ts as date)) as integer) as epoch,
          count(*) as n_steps, round(avg(value / 100), 6) as loss
        from events group by all""",
}
