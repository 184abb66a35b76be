"""Driver-side plans: mesh and layout specifications, stencil weights, transfer taps."""
