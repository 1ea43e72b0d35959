"""Reading sources, conforming types, writing warehouse tables and exports."""
