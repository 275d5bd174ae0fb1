"""An interactive page of one file's plot payload: a text that any browser shows, without other files."""

from __future__ import annotations

_PAGE = """<!doctype html>
<html lang="en"><head><meta charset="utf-8"><title>@TITLE@</title>
<style>
body { margin: 0; display: grid; grid-template-columns: 16rem 1fr; height: 100vh; font: 14px sans-serif; }
nav { overflow: auto; padding: .5rem; border-right: 1px solid #ccc; } nav h2 { font-size: 1em; margin: .6em 0 .2em; } nav label { display: block; }
main { display: grid; grid-template-rows: 1fr auto; min-width: 0; } canvas { width: 100%; height: 100%; } output { padding: .3rem .6rem; min-height: 1.4em; }
</style></head><body><nav></nav><main><canvas></canvas><output></output></main>
<script id="data" type="application/json">@DATA@</script>
<script>
const d = JSON.parse(document.getElementById("data").textContent), nav = document.querySelector("nav"), canvas = document.querySelector("canvas"), out = document.querySelector("output");
const shown = new Set(d.initial), colour = n => `hsl(${(d.names.indexOf(n) * 137.5) % 360} 65% 42%)`;
let from = d.t0, to = d.t1, held = null;
for (const g of new Set(Object.values(d.groups))) {
  nav.append(Object.assign(document.createElement("h2"), { textContent: g }));
  for (const n of d.names.filter(n => d.groups[n] === g)) {
    const label = document.createElement("label"), box = Object.assign(document.createElement("input"), { type: "checkbox", checked: shown.has(n) });
    box.onchange = () => { box.checked ? shown.add(n) : shown.delete(n); draw(); };
    label.style.color = colour(n); label.append(box, " " + d.short[n]); nav.append(label);
  }
}
const x = t => (t - from) / (to - from || 1) * canvas.width, time = p => from + p / canvas.clientWidth * (to - from);
function draw() {
  canvas.width = canvas.clientWidth; canvas.height = canvas.clientHeight;
  const c = canvas.getContext("2d"), rows = [...shown], h = canvas.height / (rows.length || 1);
  rows.forEach((n, k) => {
    const [low, high] = d.range[n], y = v => (k + 1) * h - 4 - (v - low) / (high - low) * (h - 8);
    c.fillStyle = c.strokeStyle = colour(n); c.fillText(`${d.short[n]}  ${low} .. ${high}`, 4, k * h + 12); c.beginPath();
    d.values[n].forEach((v, i) => { if (v !== null) { c.moveTo(x(d.starts[i]), y(v)); c.lineTo(x(d.ends[i]), y(v)); } });
    c.stroke();
  });
}
canvas.onmousemove = e => {
  const t = time(e.offsetX), i = d.starts.findIndex((s, k) => s <= t && t < d.ends[k]);
  out.textContent = i < 0 ? t.toFixed(2) + " s" : `${t.toFixed(2)} s, segment ${i}: ` + [...shown].map(n => `${d.short[n]} ${d.values[n][i]}`).join(", ");
  if (held !== null) { const move = time(held) - t; from += move; to += move; held = e.offsetX; draw(); }
};
canvas.onmousedown = e => held = e.offsetX; window.onmouseup = () => held = null;
canvas.onwheel = e => { e.preventDefault(); const t = time(e.offsetX), s = e.deltaY > 0 ? 1.25 : 0.8; from = t + (from - t) * s; to = t + (to - t) * s; draw(); };
canvas.ondblclick = () => { from = d.t0; to = d.t1; draw(); };
window.onresize = draw; draw();
</script></body></html>"""


def page(payload: str, title: str) -> str:
    """The page of a payload (JSON): series by group to switch on and off, wheel and drag to zoom and move, values under the pointer."""
    safe = title.replace("&", "&amp;").replace("<", "&lt;")
    return _PAGE.replace("@TITLE@", safe).replace("@DATA@", payload.replace("<", "\\u003c"))
